"""Signature rules of the license scan, written over normalised words.

A line is ``label | evidence | keyword | pattern``.  Patterns are matched against
the lower-cased words joined by single spaces, from one word's start to
another's end.  The keyword must occur in that text before the pattern is tried.
Evidence, strongest first: ``text`` (a sentence of the license), ``tag`` (an SPDX
line), ``name`` (full name with version), ``url``, ``short`` (name or
abbreviation), ``hint`` (a general phrase).
"""

from __future__ import annotations

EVIDENCE = {"text": (10, 1.0), "tag": (20, 0.95), "name": (30, 0.9), "url": (40, 0.8),
            "short": (50, 0.6), "hint": (60, 0.3)}

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RULES_TEXT = r"""
cc-by | short | cc by | cc by
gpl | short | general public license | general public license
reserved | hint | all rights reserved | all rights reserved
mit | text | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | text | the software is provided | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | text | shall be included in all copies | (?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software
mit | tag | spdx license identifier mit | spdx license identifier mit
mit | name | mit licen | (?:the )?mit licen[cs]e(?: mit)?
mit | name | expat licen | (?:the )?expat licen[cs]e
mit | name | x11 licen | (?:the )?x11 licen[cs]e
mit | url | opensource org | opensource org licen[cs]es? mit(?: licen[cs]e)?
mit | short | licensed under mit | licensed under mit
mit | short | license mit | licen[cs]e mit
mit-0 | tag | spdx license identifier mit 0 | spdx license identifier mit 0
mit-0 | name | mit no attribution | mit no attribution(?: licen[cs]e)?
apache-2.0 | text | apache license version 2 0 the | licensed under the apache license version 2 0 the license
apache-2.0 | text | except in compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | text | on an as is basis | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | tag | spdx license identifier apache | spdx license identifier apache 2 0
apache-2.0 | name | apache licen | (?:the )?apache (?:software )?licen[cs]e(?: version)? v?2(?: 0)?
apache-2.0 | url | apache org | (?:www )?apache org licen[cs]es licen[cs]e 2 0(?: (?:txt|html))?
apache-2.0 | short | apache 2 0 | apache 2 0
apache-2.0 | short | asl 2 0 | asl 2 0
apache-1.1 | tag | spdx license identifier apache 1 1 | spdx license identifier apache 1 1
apache-1.1 | name | apache software license version 1 1 | (?:the )?apache software licen[cs]e version 1 1
apache-1.0 | name | apache software license version 1 0 | (?:the )?apache software licen[cs]e version 1 0
apache | short | apache licen | (?:the )?apache (?:software )?licen[cs]e
bsd | text | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | text | must reproduce the above copyright | redistributions in binary form must reproduce the above copyright notice
bsd | text | must retain the above copyright | redistributions of source code must retain the above copyright notice
bsd | text | this software is provided by the copyright holders | this software is provided by the copyright holders and contributors as is
bsd-3-clause | text | endorse or promote products | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | tag | spdx license identifier bsd 3 | spdx license identifier bsd 3 clause
bsd-3-clause | name | bsd | (?:the )?(?:3 clause|three clause|new|modified|revised) bsd(?: licen[cs]e)?
bsd-3-clause | name | bsd 3 clause | (?:the )?bsd 3 clause(?: new or revised)?(?: licen[cs]e)?
bsd-3-clause | url | opensource org | opensource org licen[cs]es? bsd 3 clause
bsd-2-clause | tag | spdx license identifier bsd 2 | spdx license identifier bsd 2 clause
bsd-2-clause | name | bsd | (?:the )?(?:2 clause|two clause|simplified|freebsd) bsd(?: licen[cs]e)?
bsd-2-clause | name | bsd 2 clause | (?:the )?bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-2-clause | url | opensource org | opensource org licen[cs]es? bsd 2 clause
bsd-4-clause | text | all advertising materials | all advertising materials mentioning features or use of this software must display
bsd-4-clause | tag | spdx license identifier bsd 4 | spdx license identifier bsd 4 clause
bsd-4-clause | name | bsd | (?:the )?(?:4 clause|four clause|original) bsd(?: licen[cs]e)?
0bsd | tag | spdx license identifier 0bsd | spdx license identifier 0bsd
0bsd | name | zero clause bsd | zero clause bsd(?: licen[cs]e)?
bsd | short | bsd licen | bsd licen[cs]ed?
bsd | short | bsd style | bsd style(?: licen[cs]e)?
bsd | short | licensed under bsd | licensed under (?:the )?bsd
isc | text | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | tag | spdx license identifier isc | spdx license identifier isc
isc | name | isc licen | (?:the )?isc licen[cs]e
isc | url | opensource org | opensource org licen[cs]es? isc
gpl-3.0 | text | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license
gpl-3.0 | tag | spdx license identifier gpl 3 | spdx license identifier gpl 3 0(?: (?:only|or later))?
gpl-3.0 | name | general public license | (?:the )?gnu general public license(?: gpl)? (?:version|v) ?3(?: 0)?(?: or (?:any )?later)?
gpl-3.0 | name | general public license v3 | (?:gnu )?general public license v3(?: 0)?
gpl-3.0 | url | gnu org | (?:www )?gnu org licen[cs]es gpl 3 0(?: (?:html|txt|en html))?
gpl-3.0 | short | gplv3 | (?:gnu )?gplv3
gpl-3.0 | short | gpl 3 0 | (?:gnu )?gpl 3 0(?: only| or later)?
gpl-3.0 | short | gpl v3 | (?:gnu )?gpl v3
gpl-3.0 | short | gpl version 3 | (?:gnu )?gpl version 3
gpl-2.0 | text | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license
gpl-2.0 | tag | spdx license identifier gpl 2 | spdx license identifier gpl 2 0(?: (?:only|or later))?
gpl-2.0 | name | general public license | (?:the )?gnu general public license(?: gpl)? (?:version|v) ?2(?: 0)?(?: or (?:any )?later)?
gpl-2.0 | name | general public license v2 | (?:gnu )?general public license v2(?: 0)?
gpl-2.0 | url | gnu org | (?:www )?gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0(?: (?:html|txt|en html))?
gpl-2.0 | short | gplv2 | (?:gnu )?gplv2
gpl-2.0 | short | gpl 2 0 | (?:gnu )?gpl 2 0(?: only| or later)?
gpl-2.0 | short | gpl v2 | (?:gnu )?gpl v2
gpl-2.0 | short | gpl version 2 | (?:gnu )?gpl version 2
gpl-1.0 | tag | spdx license identifier gpl 1 | spdx license identifier gpl 1 0(?: (?:only|or later))?
gpl-1.0 | name | general public license version 1 | gnu general public license version 1
gpl | text | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | text | you should have received a copy of the gnu general | you should have received a copy of the gnu general public license
gpl | name | gnu general public license | (?:the )?gnu general public license(?: gpl)?
gpl | url | gnu org | (?:www )?gnu org licen[cs]es gpl
gpl | short | gnu gpl | (?:the )?gnu gpl
gpl | short | gpl licen | gpl licen[cs]ed?
gpl | short | under the gpl | (?:released |licensed |distributed )?under the gpl
lgpl-3.0 | tag | spdx license identifier lgpl 3 | spdx license identifier lgpl 3 0(?: (?:only|or later))?
lgpl-3.0 | name | lesser general public license | (?:the )?gnu lesser general public license (?:version|v) ?3(?: 0)?
lgpl-3.0 | short | lgplv3 | (?:gnu )?lgplv3
lgpl-3.0 | short | lgpl 3 0 | (?:gnu )?lgpl 3 0
lgpl-2.1 | tag | spdx license identifier lgpl 2 1 | spdx license identifier lgpl 2 1(?: (?:only|or later))?
lgpl-2.1 | name | lesser general public license | (?:the )?gnu lesser general public license (?:version|v) ?2 1
lgpl-2.1 | short | lgplv2 1 | (?:gnu )?lgplv2 1
lgpl-2.1 | short | lgpl 2 1 | (?:gnu )?lgpl 2 1
lgpl-2.0 | tag | spdx license identifier lgpl 2 0 | spdx license identifier lgpl 2 0(?: (?:only|or later))?
lgpl-2.0 | name | library general public license | (?:the )?gnu library general public license(?: version 2(?: 0)?)?
lgpl | text | under the terms of the gnu lesser | under the terms of the gnu lesser general public license
lgpl | name | lesser general public license | (?:the )?(?:gnu )?lesser general public license
lgpl | url | gnu org | (?:www )?gnu org (?:licen[cs]es|copyleft) lesser(?: html)?
lgpl | short | gnu lgpl | gnu lgpl
lgpl | short | lgpl licen | lgpl licen[cs]ed?
agpl-3.0 | text | under the terms of the gnu affero | under the terms of the gnu affero general public license
agpl-3.0 | tag | spdx license identifier agpl | spdx license identifier agpl 3 0(?: (?:only|or later))?
agpl-3.0 | name | affero general public license | (?:the )?(?:gnu )?affero general public license(?: (?:version|v) ?3(?: 0)?)?
agpl-3.0 | url | gnu org | (?:www )?gnu org licen[cs]es agpl(?: 3 0)?(?: html)?
agpl-3.0 | short | agplv3 | (?:gnu )?agplv3
agpl-3.0 | short | agpl 3 0 | (?:gnu )?agpl 3 0
agpl-3.0 | short | gnu agpl | gnu agpl
gfdl | text | under the terms of the gnu free documentation | under the terms of the gnu free documentation license
gfdl | tag | spdx license identifier gfdl | spdx license identifier gfdl 1 [123](?: (?:only|or later))?
gfdl | name | free documentation license | (?:the )?gnu free documentation license(?: version 1 [123])?
gfdl | short | gnu fdl | gnu fdl
mpl-2.0 | text | subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | tag | spdx license identifier mpl 2 | spdx license identifier mpl 2 0
mpl-2.0 | name | mozilla public licen | (?:the )?mozilla public licen[cs]e (?:version|v) ?2(?: 0)?
mpl-2.0 | name | mozilla public licen | (?:the )?mozilla public licen[cs]e 2 0
mpl-2.0 | url | mozilla org | (?:www )?mozilla org mpl 2 0
mpl-2.0 | short | mpl 2 0 | mpl 2 0
mpl-2.0 | short | mplv2 | mplv2
mpl-1.1 | tag | spdx license identifier mpl 1 1 | spdx license identifier mpl 1 1
mpl-1.1 | name | mozilla public licen | (?:the )?mozilla public licen[cs]e (?:version )?1 1
mpl-1.1 | short | mpl 1 1 | mpl 1 1
mpl | short | mozilla public licen | (?:the )?mozilla public licen[cs]e
epl-2.0 | tag | spdx license identifier epl 2 | spdx license identifier epl 2 0
epl-2.0 | name | eclipse public licen | (?:the )?eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-2.0 | short | epl 2 0 | epl 2 0
epl-1.0 | tag | spdx license identifier epl 1 | spdx license identifier epl 1 0
epl-1.0 | name | eclipse public licen | (?:the )?eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl-1.0 | short | epl 1 0 | epl 1 0
epl | text | made available under the terms of the eclipse | made available under the terms of the eclipse public license
epl | short | eclipse public licen | (?:the )?eclipse public licen[cs]e
edl-1.0 | name | eclipse distribution licen | (?:the )?eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?
cddl-1.0 | tag | spdx license identifier cddl | spdx license identifier cddl 1 [01]
cddl-1.0 | text | common development and distribution license the | subject to the terms of the common development and distribution license the license
cddl-1.0 | name | common development and distribution licen | (?:the )?common development and distribution licen[cs]e(?: cddl)?(?: (?:version )?1 [01])?
cddl-1.0 | short | cddl 1 | cddl 1 [01]
cpl-1.0 | tag | spdx license identifier cpl | spdx license identifier cpl 1 0
cpl-1.0 | name | common public licen | (?:the )?common public licen[cs]e(?: (?:version )?1 0)?
ipl-1.0 | name | ibm public licen | (?:the )?ibm public licen[cs]e(?: (?:version )?1 0)?
eupl-1.2 | tag | spdx license identifier eupl | spdx license identifier eupl 1 [12]
eupl-1.2 | text | licensed under the eupl | licensed under the eupl(?: version)? 1 [12](?: or as soon they will be approved by the european commission)?
eupl-1.2 | name | european union public licen | (?:the )?european union public licen[cs]e(?: (?:version |v )?1 [12])?
eupl-1.2 | short | eupl 1 | eupl 1 [12]
artistic-2.0 | tag | spdx license identifier artistic 2 | spdx license identifier artistic 2 0
artistic-2.0 | name | artistic licen | (?:the )?artistic licen[cs]e (?:version )?2 0
artistic-1.0 | tag | spdx license identifier artistic 1 | spdx license identifier artistic 1 0(?: perl)?
artistic-1.0 | name | artistic licen | (?:the )?artistic licen[cs]e (?:version )?1 0
artistic | text | same terms as perl | (?:redistribute it and or modify it )?under the same terms as perl itself
artistic | short | artistic licen | (?:the )?artistic licen[cs]e
zlib | text | this software is provided as is without any express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | text | altered source versions must | altered source versions must be plainly marked as such
zlib | tag | spdx license identifier zlib | spdx license identifier zlib
zlib | name | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | tag | spdx license identifier libpng | spdx license identifier libpng(?: 2 0)?
libpng | name | libpng licen | (?:the )?libpng licen[cs]e
bsl-1.0 | text | boost software license version | distributed under the boost software license version 1 0
bsl-1.0 | tag | spdx license identifier bsl | spdx license identifier bsl 1 0
bsl-1.0 | name | boost software licen | (?:the )?boost software licen[cs]e(?: (?:version )?1 0)?
bsl-1.0 | url | boost org | (?:www )?boost org licen[cs]e 1 0(?: txt)?
unlicense | text | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | tag | spdx license identifier unlicense | spdx license identifier unlicense
unlicense | name | the unlicense | the unlicense
unlicense | url | unlicense org | unlicense org
wtfpl | text | do what the fuck you want | do what the fuck you want to public license
wtfpl | tag | spdx license identifier wtfpl | spdx license identifier wtfpl
wtfpl | short | wtfpl | wtfpl
cc0-1.0 | tag | spdx license identifier cc0 | spdx license identifier cc0 1 0
cc0-1.0 | text | waived all copyright | (?:has )?waived all copyright and related or neighboring rights
cc0-1.0 | name | cc0 | cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0 | url | publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | short | cc0 | cc0
cc-by-4.0 | tag | spdx license identifier cc by 4 | spdx license identifier cc by 4 0
cc-by-4.0 | text | creative commons attribution 4 | licensed under (?:a |the )?creative commons attribution 4 0(?: international)?(?: licen[cs]e)?
cc-by-4.0 | name | creative commons attribution 4 | creative commons attribution 4 0(?: international)?(?: licen[cs]e)?
cc-by-4.0 | url | creativecommons org | creativecommons org licen[cs]es by 4 0
cc-by-4.0 | short | cc by 4 0 | cc by 4 0
cc-by-3.0 | tag | spdx license identifier cc by 3 | spdx license identifier cc by 3 0
cc-by-3.0 | name | creative commons attribution 3 | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
cc-by-3.0 | url | creativecommons org | creativecommons org licen[cs]es by 3 0
cc-by-3.0 | short | cc by 3 0 | cc by 3 0
cc-by-2.0 | url | creativecommons org | creativecommons org licen[cs]es by 2 [05]
cc-by-2.0 | short | cc by 2 | cc by 2 [05]
cc-by-sa-4.0 | tag | spdx license identifier cc by sa 4 | spdx license identifier cc by sa 4 0
cc-by-sa-4.0 | name | sharealike 4 | (?:creative commons )?attribution share ?alike 4 0(?: international)?(?: licen[cs]e)?
cc-by-sa-4.0 | url | creativecommons org | creativecommons org licen[cs]es by sa 4 0
cc-by-sa-4.0 | short | cc by sa 4 | cc by sa 4 0
cc-by-sa-3.0 | tag | spdx license identifier cc by sa 3 | spdx license identifier cc by sa 3 0
cc-by-sa-3.0 | name | sharealike 3 | (?:creative commons )?attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-sa-3.0 | url | creativecommons org | creativecommons org licen[cs]es by sa 3 0
cc-by-sa-3.0 | short | cc by sa 3 | cc by sa 3 0
cc-by-sa | short | cc by sa | cc by sa
cc-by-sa | short | sharealike | (?:creative commons )?attribution share ?alike
cc-by-nc-4.0 | tag | spdx license identifier cc by nc 4 | spdx license identifier cc by nc 4 0
cc-by-nc-4.0 | name | noncommercial 4 | (?:creative commons )?attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-4.0 | url | creativecommons org | creativecommons org licen[cs]es by nc 4 0
cc-by-nc-4.0 | short | cc by nc 4 | cc by nc 4 0
cc-by-nc | short | cc by nc | cc by nc
cc-by-nc | short | noncommercial | (?:creative commons )?attribution non ?commercial
cc-by-nc-sa-4.0 | tag | spdx license identifier cc by nc sa | spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 | name | noncommercial sharealike 4 | (?:creative commons )?attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-sa-4.0 | url | creativecommons org | creativecommons org licen[cs]es by nc sa 4 0
cc-by-nc-sa-4.0 | short | cc by nc sa 4 | cc by nc sa 4 0
cc-by-nc-sa | short | cc by nc sa | cc by nc sa
cc-by-nc-nd-4.0 | tag | spdx license identifier cc by nc nd | spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 | url | creativecommons org | creativecommons org licen[cs]es by nc nd 4 0
cc-by-nc-nd-4.0 | short | cc by nc nd 4 | cc by nc nd 4 0
cc-by-nc-nd | short | cc by nc nd | cc by nc nd
cc-by-nd-4.0 | tag | spdx license identifier cc by nd | spdx license identifier cc by nd 4 0
cc-by-nd-4.0 | url | creativecommons org | creativecommons org licen[cs]es by nd 4 0
cc-by-nd-4.0 | short | cc by nd 4 | cc by nd 4 0
cc-by-nd | short | cc by nd | cc by nd
cc-by | name | creative commons attribution | (?:the )?creative commons attribution licen[cs]e
cc | hint | creative commons | (?:a |the )?creative commons licen[cs]e
odbl-1.0 | tag | spdx license identifier odbl | spdx license identifier odbl 1 0
odbl-1.0 | name | open database licen | (?:the )?open database licen[cs]e(?: odbl)?(?: (?:version |v )?1 0)?
odc-by-1.0 | name | open data commons attribution | open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?
pddl-1.0 | name | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[cs]e
ofl-1.1 | tag | spdx license identifier ofl | spdx license identifier ofl 1 [01]
ofl-1.1 | text | sil open font license version | licensed under the sil open font license version 1 1
ofl-1.1 | name | open font licen | (?:the )?(?:sil )?open font licen[cs]e(?: (?:version )?1 [01])?
ofl-1.1 | url | scripts sil org | scripts sil org ofl
psf-2.0 | tag | spdx license identifier psf | spdx license identifier psf 2 0
psf-2.0 | name | python software foundation licen | (?:the )?python software foundation licen[cs]e(?: version 2)?
python-2.0 | tag | spdx license identifier python | spdx license identifier python 2 0
php-3.01 | tag | spdx license identifier php | spdx license identifier php 3 0 ?1?
php-3.01 | name | php licen | (?:the )?php licen[cs]e(?: version 3 0 ?1?)?
ruby | name | ruby licen | (?:the )?ruby licen[cs]e
ruby | text | same terms as ruby | under the same terms as ruby
postgresql | tag | spdx license identifier postgresql | spdx license identifier postgresql
postgresql | name | postgresql licen | (?:the )?postgresql licen[cs]e
openssl | tag | spdx license identifier openssl | spdx license identifier openssl
openssl | name | openssl licen | (?:the )?openssl(?: ssleay)? licen[cs]e
curl | tag | spdx license identifier curl | spdx license identifier curl
ncsa | tag | spdx license identifier ncsa | spdx license identifier ncsa
ncsa | name | illinois | (?:the )?university of illinois(?: ncsa)? open source licen[cs]e
ncsa | short | ncsa licen | ncsa licen[cs]e
ms-pl | tag | spdx license identifier ms pl | spdx license identifier ms pl
ms-pl | name | microsoft public licen | (?:the )?microsoft public licen[cs]e(?: ms pl)?
ms-rl | tag | spdx license identifier ms rl | spdx license identifier ms rl
ms-rl | name | microsoft reciprocal licen | (?:the )?microsoft reciprocal licen[cs]e(?: ms rl)?
upl-1.0 | tag | spdx license identifier upl | spdx license identifier upl 1 0
upl-1.0 | name | universal permissive licen | (?:the )?universal permissive licen[cs]e(?: (?:version |v )?1 0)?
osl-3.0 | tag | spdx license identifier osl | spdx license identifier osl 3 0
osl-3.0 | name | open software licen | (?:the )?open software licen[cs]e(?: (?:version |v )?3 0)?
afl-3.0 | tag | spdx license identifier afl | spdx license identifier afl 3 0
afl-3.0 | name | academic free licen | (?:the )?academic free licen[cs]e(?: (?:version |v )?[123] [01])?
qpl-1.0 | name | q public licen | (?:the )?q public licen[cs]e(?: (?:version )?1 0)?
sleepycat | name | sleepycat licen | (?:the )?sleepycat licen[cs]e
vim | name | vim licen | (?:the )?vim licen[cs]e
ecl-2.0 | name | educational community licen | (?:the )?educational community licen[cs]e(?: version 2 0)?
w3c | name | w3c software | (?:the )?w3c software(?: notice and| and document)? licen[cs]e
unicode | name | unicode | unicode (?:inc )?licen[cs]e agreement(?: data files and software)?
nasa-1.3 | name | nasa open source | nasa open source agreement(?: version)? 1 3
sspl-1.0 | tag | spdx license identifier sspl | spdx license identifier sspl 1 0
sspl-1.0 | name | server side public licen | (?:the )?server side public licen[cs]e(?: (?:version |v )?1)?
busl-1.1 | tag | spdx license identifier busl | spdx license identifier busl 1 1
busl-1.1 | name | business source licen | (?:the )?business source licen[cs]e(?: (?:version )?1 1)?
elastic-2.0 | name | elastic licen | (?:the )?elastic licen[cs]e(?: (?:version |v )?2 0)?
commons-clause | name | commons clause | commons clause(?: licen[cs]e)?(?: condition)?(?: v ?1 0)?
mulan-2.0 | name | mulan | mulan (?:psl|permissive software licen[cs]e)(?: (?:version |v )?2)?
openrail | name | openrail | (?:creativeml |bigscience )?openrail(?: [m])?(?: licen[cs]e)?
llama | name | community licen | llama [234](?: 1)? community licen[cs]e(?: agreement)?
public-domain | hint | public domain | (?:released |placed |dedicated )?(?:in|into|to) the public domain
public-domain | hint | no rights reserved | no rights reserved
proprietary | text | confidential and proprietary | (?:this (?:software|document) is )?(?:the )?confidential and proprietary(?: information)?
proprietary | text | unauthorized copying | unauthorized copying of this (?:file|software|document)
proprietary | hint | proprietary licen | proprietary licen[cs]e
proprietary | hint | all right reserved | all right reserved
commercial | hint | commercial licen | commercial licen[cs]e(?: agreement)?
eula | name | end user license agreement | end user license agreement
eula | hint | license agreement | (?:software )?license agreement
copyright | hint | copyright c | copyright c (?:19|20)[0-9]{2}
copyright | hint | copyright 19 | copyright 19[0-9]{2}
copyright | hint | copyright 20 | copyright 20[0-9]{2}
copyright | hint | some rights reserved | some rights reserved
copyright | hint | alle rechte vorbehalten | alle rechte vorbehalten
copyright | hint | tous droits | tous droits réservés
copyright | hint | todos los derechos | todos los derechos reservados
unknown-license | hint | licensed under | (?:is )?licensed under (?:the|a) [0-9a-z]+(?: [0-9a-z]+)? licen[cs]e
unknown-license | hint | released under | released under (?:the|a) [0-9a-z]+(?: [0-9a-z]+)? licen[cs]e
unknown-license | hint | spdx license identifier | spdx license identifier [0-9a-z]+
"""


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, pattern) in the order above."""
    out = []
    for line in RULES_TEXT.strip().splitlines():
        label, evidence, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, *EVIDENCE[evidence], keyword, pattern))
    return out
