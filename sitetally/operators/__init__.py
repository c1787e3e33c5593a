"""DataFrame operators: mapping joins, section frames, levels, reshaping."""
