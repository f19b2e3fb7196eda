"""The signature rules of the license scan, in order of priority within their kind.

A line is: label | kind | keyword | pattern. Patterns are matched against a text's words in lower case with one space
between them, where punctuation parts words: version 2.0 reads "version 2 0". They begin and end at words. <lic> stands for
license in either spelling, singular or plural, <v> for what may stand before a version number, and <w> for one word of any kind. The
keyword is a piece of text that every match of the pattern holds.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Kinds from the surest to the least: what is worth how much.
KINDS = {"tag": 1.0, "text": 0.95, "url": 0.9, "notice": 0.85, "name": 0.7, "hint": 0.4}

_SHORT = {"<lic>": "licen[cs]es?", "<v>": "(?:version |ver |v )?v?", "<w>": "[^ ]+", "<the>": "(?:the |an |a )?"}

#: Fixed values, written by hand.
TABLE = """
mit | tag | spdx license identifier mit | spdx license identifier mit
mit | tag | license mit | (?:classifier|package|project) license mit
mit | text | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | subject to the following conditions the above copyright notice and this permission notice | subject to the following conditions the above copyright notice and this permission notice shall be included
mit | text | without restriction including without limitation the rights to use | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | url | opensource org licenses mit | opensource org licenses mit(?: license)?
mit | url | mit license org | mit license org
mit | notice | mit licen | (?:released|licensed|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?mit <lic>
mit | notice | expat licen | (?:released|licensed|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?expat <lic>
mit | notice | mit licen | under (?:the )?terms of (?:the )?mit <lic>
mit | name | mit x11 | mit x11 <lic>
mit | name | expat licen | expat <lic>
mit | name | mit licen | mit <lic>
mit | name | mit style | mit style <lic>
mit-0 | tag | spdx license identifier mit 0 | spdx license identifier mit 0
mit-0 | name | mit no attribution | mit no attribution(?: <lic>)?
apache-2 | tag | spdx license identifier apache 2 | spdx license identifier apache 2(?: 0)?
apache-2 | tag | license apache 2 | (?:classifier|package|project) license apache 2(?: 0)?
apache-2 | text | unless required by applicable law or agreed to in writing software | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | text | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?
apache-2 | text | terms and conditions for use reproduction and distribution | apache license version 2 0 january 2004 (?:<w> ){0,6}terms and conditions for use reproduction and distribution
apache-2 | url | apache org licenses license 2 | apache org licenses license 2 0(?: txt| html)?
apache-2 | url | opensource org licenses apache 2 | opensource org licenses apache 2 0
apache-2 | notice | apache | (?:released|licensed|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: foundation)? <lic> <v>2(?: 0)?
apache-2 | notice | apache 2 | (?:released|licensed|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache 2(?: 0)?(?: <lic>)?
apache-2 | name | apache | apache(?: software)? <lic> <v>2(?: 0)?
apache-2 | name | apache 2 | apache 2(?: 0)? <lic>
apache-2 | name | asl 2 | asl 2 0
apache-1.1 | tag | spdx license identifier apache 1 1 | spdx license identifier apache 1 1
apache-1.1 | url | apache org licenses license 1 1 | apache org licenses license 1 1
apache-1.1 | name | apache software licen | apache software <lic> <v>1 1
apache | hint | apache | apache(?: software)? <lic>
cc-by-nc | tag | spdx license identifier cc by nc | spdx license identifier cc by nc [1-4] [05]
cc-by-nc | url | creativecommons org licenses by nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nc | notice | cc by nc | (?:released|licensed|distributed|available|published|shared) under (?:the )?(?:terms of )?(?:the )?<the>cc by nc(?: [1-4] [05])?
cc-by-nc | notice | attribution non | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? <lic>
cc-by-nc | name | cc by nc | cc by nc(?: [1-4] [05])?
cc-by-nc | name | attribution non | (?:creative commons )?attribution non ?commercial [1-4] [05](?: international| unported| generic)?
cc-by-nc-sa | tag | spdx license identifier cc by nc sa | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa | url | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa | notice | attribution non | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? <lic>
cc-by-nc-sa | notice | cc by nc sa | (?:released|licensed|distributed|available|published|shared) under (?:the )?(?:terms of )?(?:the )?<the>cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | name | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | name | attribution non | (?:creative commons )?attribution non ?commercial share ?alike [1-4] [05](?: international| unported| generic)?
cc-by-nc-nd | tag | spdx license identifier cc by nc nd | spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd | url | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd | notice | attribution non | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? <lic>
cc-by-nc-nd | name | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd | name | attribution non | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s? [1-4] [05](?: international| unported| generic)?
cc-by-sa | tag | spdx license identifier cc by sa | spdx license identifier cc by sa [1-4] [05]
cc-by-sa | url | creativecommons org licenses by sa | creativecommons org licenses by sa [1-4] [05]
cc-by-sa | notice | attribution share | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? <lic>
cc-by-sa | notice | cc by sa | (?:released|licensed|distributed|available|published|shared) under (?:the )?(?:terms of )?(?:the )?<the>cc by sa(?: [1-4] [05])?
cc-by-sa | name | cc by sa | cc by sa(?: [1-4] [05])?
cc-by-sa | name | attribution share | (?:creative commons )?attribution share ?alike [1-4] [05](?: international| unported| generic)?
cc-by-nd | tag | spdx license identifier cc by nd | spdx license identifier cc by nd [1-4] [05]
cc-by-nd | url | creativecommons org licenses by nd | creativecommons org licenses by nd [1-4] [05]
cc-by-nd | notice | attribution no | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? <lic>
cc-by-nd | name | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-nd | name | attribution no | (?:creative commons )?attribution no ?deriv(?:ative)?s? [1-4] [05](?: international| unported| generic)?
cc-by | tag | spdx license identifier cc by | spdx license identifier cc by [1-4] [05]
cc-by | url | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc-by | notice | creative commons attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? <lic>
cc-by | notice | cc by | (?:released|licensed|distributed|available|published|shared) under (?:the )?(?:terms of )?(?:the )?<the>cc by(?: [1-4] [05])?
cc-by | name | cc by | cc by [1-4] [05]
cc-by | name | creative commons attribution | creative commons attribution [1-4] [05](?: international| unported| generic)?
cc0 | tag | spdx license identifier cc0 | spdx license identifier cc0 1 0
cc0 | text | the person who associated a work with this deed | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | url | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0 | notice | cc0 | (?:released|licensed|distributed|available|published|dedicated) (?:under|to|using|with) (?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0 | name | cc0 1 0 | (?:creative commons )?cc0 1 0(?: universal)?(?: public domain dedication)?
cc0 | name | creative commons zero | creative commons zero(?: <v>1 0)?(?: universal)?
creative-commons | hint | creative commons licen | creative commons <lic>
creative-commons | hint | creativecommons org | creativecommons org licenses
public-domain | text | this is free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
public-domain | url | creativecommons org publicdomain mark | creativecommons org publicdomain mark 1 0
public-domain | notice | public domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | notice | in the public domain | (?:this|the) (?:work|file|text|book|document|image|software|code) is (?:hereby )?in the public domain
unlicense | tag | spdx license identifier unlicense | spdx license identifier unlicense
unlicense | url | unlicense org | unlicense org
unlicense | name | the unlicense | (?:under )?the unlicense
wtfpl | tag | spdx license identifier wtfpl | spdx license identifier wtfpl
wtfpl | url | wtfpl net | wtfpl net
wtfpl | name | what the fuck you want to | do what the fuck you want to public <lic>
wtfpl | name | wtfpl | wtfpl(?: <lic>)?
gpl-3 | tag | spdx license identifier gpl 3 | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 | text | gnu general public license as published by the free software foundation either version 3 | gnu general public license as published by the free software foundation either version 3 of the license
gpl-3 | text | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-3 | url | gnu org licenses gpl 3 | gnu org licenses gpl 3 0(?: html| txt| en html)*
gpl-3 | url | opensource org licenses gpl 3 | opensource org licenses gpl 3 0
gpl-3 | notice | general public licen | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public <lic> <v>3(?: 0)?
gpl-3 | notice | gpl | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl <v>3(?: 0)?
gpl-3 | notice | gplv3 | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gplv3
gpl-3 | name | general public licen | (?:gnu )?general public <lic> <v>3(?: 0)?
gpl-3 | name | gpl | (?:gnu )?gpl <v>3(?: 0)?
gpl-3 | name | gplv3 | (?:gnu )?gplv3
gpl-2 | tag | spdx license identifier gpl 2 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 | text | gnu general public license as published by the free software foundation either version 2 | gnu general public license as published by the free software foundation either version 2 of the license
gpl-2 | text | gnu general public license version 2 as published by the free software foundation | gnu general public license version 2 as published by the free software foundation
gpl-2 | text | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-2 | url | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)*
gpl-2 | url | opensource org licenses gpl 2 | opensource org licenses gpl 2 0
gpl-2 | notice | general public licen | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public <lic> <v>2(?: 0)?
gpl-2 | notice | gpl | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl <v>2(?: 0)?
gpl-2 | name | general public licen | (?:gnu )?general public <lic> <v>2(?: 0)?
gpl-2 | name | gpl | (?:gnu )?gpl <v>2(?: 0)?
gpl-2 | name | gplv2 | (?:gnu )?gplv2
gpl-1 | tag | spdx license identifier gpl 1 | spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 | name | general public licen | (?:gnu )?general public <lic> <v>1(?: 0)?
gpl | url | gnu org licenses gpl | gnu org licenses gpl(?: html| txt)?
gpl | url | gnu org copyleft gpl | gnu org copyleft gpl html
gpl | text | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with this (?:program|library|software|package|file)
gpl | notice | gpl | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl | notice | general public licen | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public <lic>
gpl | hint | gnu general public licen | gnu general public <lic>
gpl | hint | gnu gpl | gnu gpl
gpl-exception | text | as a special exception | as a special exception (?:<w> ){1,12}(?:link|linking|combine|executable)
gpl-exception | name | classpath exception | (?:gnu )?classpath exception(?: 2 0)?
gpl-exception | name | gcc runtime library exception | gcc runtime library exception(?: 3 1)?
lgpl-3 | tag | spdx license identifier lgpl 3 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | text | lesser general public license as published by the free software foundation either version 3 | gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-3 | url | gnu org licenses lgpl 3 | gnu org licenses lgpl 3 0(?: html| txt| en html)*
lgpl-3 | name | lesser general public licen | (?:gnu )?lesser general public <lic> <v>3(?: 0)?
lgpl-3 | name | lgpl | (?:gnu )?lgpl <v>3(?: 0)?
lgpl-3 | name | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | tag | spdx license identifier lgpl 2 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | text | lesser general public license as published by the free software foundation either version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-2.1 | text | gnu lesser general public license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-2.1 | url | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)*
lgpl-2.1 | name | lesser general public licen | (?:gnu )?lesser general public <lic> <v>2 1
lgpl-2.1 | name | lgpl | (?:gnu )?lgpl <v>2 1
lgpl-2 | tag | spdx license identifier lgpl 2 0 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 | text | library general public license as published by the free software foundation | gnu library general public license as published by the free software foundation either version 2 of the license
lgpl-2 | name | library general public licen | (?:gnu )?library general public <lic>(?: <v>2(?: 0)?)?
lgpl | url | gnu org licenses lgpl | gnu org licenses lgpl(?: html| txt)?
lgpl | text | you should have received a copy of the gnu lesser general public license | you should have received a copy of the gnu lesser general public license along with this (?:program|library|software)
lgpl | notice | lgpl | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl | notice | lesser general public licen | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public <lic>
lgpl | hint | lesser general public licen | (?:gnu )?lesser general public <lic>
lgpl | hint | gnu lgpl | gnu lgpl
agpl-3 | tag | spdx license identifier agpl 3 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | text | affero general public license as published by the free software foundation either version 3 | gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3 | url | gnu org licenses agpl 3 | gnu org licenses agpl 3 0(?: html| txt| en html)*
agpl-3 | name | affero general public licen | (?:gnu )?affero general public <lic> <v>3(?: 0)?
agpl-3 | name | agpl | (?:gnu )?agpl <v>3(?: 0)?
agpl-3 | name | agplv3 | (?:gnu )?agplv3
agpl | hint | affero general public licen | (?:gnu )?affero general public <lic>
agpl | notice | agpl | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
fdl | tag | spdx license identifier gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
fdl | text | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
fdl | url | gnu org licenses fdl | gnu org licenses fdl(?: 1 [123])?(?: html| txt)?
fdl | name | free documentation licen | gnu free documentation <lic>(?: <v>1 [123])?
bsd-3 | tag | spdx license identifier bsd 3 clause | spdx license identifier bsd 3 clause
bsd-3 | text | may be used to endorse or promote products derived from this software without specific prior written permission | (?:neither the name of|the names? of|the) (?:<w> ){1,20}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 | url | opensource org licenses bsd 3 clause | opensource org licenses bsd 3 clause
bsd-3 | name | bsd 3 clause | bsd 3 clause(?: <lic>)?
bsd-3 | name | clause bsd | (?:3|three) clause bsd(?: <lic>)?
bsd-3 | name | new bsd licen | new bsd <lic>
bsd-3 | name | modified bsd licen | modified bsd <lic>
bsd-3 | name | revised bsd licen | revised bsd <lic>
bsd-2 | tag | spdx license identifier bsd 2 clause | spdx license identifier bsd 2 clause
bsd-2 | url | opensource org licenses bsd 2 clause | opensource org licenses bsd 2 clause
bsd-2 | name | bsd 2 clause | bsd 2 clause(?: <lic>)?
bsd-2 | name | clause bsd | (?:2|two) clause bsd(?: <lic>)?
bsd-2 | name | simplified bsd licen | simplified bsd <lic>
bsd-2 | name | freebsd licen | freebsd <lic>
bsd-4 | tag | spdx license identifier bsd 4 clause | spdx license identifier bsd 4 clause
bsd-4 | text | all advertising materials mentioning features or use of this software | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4 | name | bsd 4 clause | bsd 4 clause(?: <lic>)?
bsd-4 | name | original bsd licen | original bsd <lic>
bsd-0 | tag | spdx license identifier 0bsd | spdx license identifier 0bsd
bsd-0 | name | zero clause bsd | zero clause bsd(?: <lic>)?
bsd | text | redistributions of source code must retain the above copyright notice | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | text | redistributions in binary form must reproduce the above copyright notice | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | url | opensource org licenses bsd license | opensource org licenses bsd license(?: php)?
bsd | notice | bsd | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?bsd(?: style)? <lic>
bsd | hint | bsd licen | bsd <lic>
bsd | hint | bsd style licen | bsd style <lic>
isc | tag | spdx license identifier isc | spdx license identifier isc
isc | text | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | url | opensource org licenses isc | opensource org licenses isc(?: license)?(?: txt)?
isc | name | isc licen | isc <lic>
mpl-2 | tag | spdx license identifier mpl 2 | spdx license identifier mpl 2 0
mpl-2 | text | this source code form is subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license <v>2 0
mpl-2 | url | mozilla org mpl 2 0 | mozilla org mpl 2 0
mpl-2 | url | mozilla org mpl mpl 2 0 | mozilla org mpl mpl 2 0(?: txt)?
mpl-2 | name | mozilla public licen | mozilla public <lic> <v>2(?: 0)?
mpl-2 | name | mpl 2 0 | mpl 2 0
mpl-1.1 | tag | spdx license identifier mpl 1 1 | spdx license identifier mpl 1 1
mpl-1.1 | text | subject to the mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | url | mozilla org mpl | mozilla org mpl mpl 1 1(?: html| txt)?
mpl-1.1 | name | mozilla public licen | mozilla public <lic> <v>1 1
mpl | hint | mozilla public licen | mozilla public <lic>
epl-2 | tag | spdx license identifier epl 2 | spdx license identifier epl 2 0
epl-2 | url | eclipse org legal epl | eclipse org legal epl (?:<v>20|2 0)(?: html)?
epl-2 | name | eclipse public licen | eclipse public <lic> <v>2(?: 0)?
epl-1 | tag | spdx license identifier epl 1 | spdx license identifier epl 1 0
epl-1 | url | eclipse org legal epl v10 | eclipse org legal epl v10(?: html)?
epl-1 | name | eclipse public licen | eclipse public <lic> <v>1(?: 0)?
epl | hint | eclipse public licen | eclipse public <lic>
edl | name | eclipse distribution licen | eclipse distribution <lic>(?: <v>1 0)?
cddl-1 | tag | spdx license identifier cddl 1 | spdx license identifier cddl 1 [01]
cddl-1 | name | common development and distribution licen | common development and distribution <lic>(?: cddl)?(?: <v>1 [01])?
cddl-1 | name | cddl | cddl <v>1 [01]
cpl-1 | name | common public licen | common public <lic>(?: <v>1 0)?
artistic-2 | tag | spdx license identifier artistic 2 | spdx license identifier artistic 2 0
artistic-2 | url | opensource org licenses artistic license 2 | opensource org licenses artistic license 2 0
artistic-2 | name | artistic licen | artistic <lic> <v>2(?: 0)?
artistic-1 | tag | spdx license identifier artistic 1 | spdx license identifier artistic 1 0
artistic-1 | name | artistic licen | artistic <lic> <v>1(?: 0)?
artistic | hint | artistic licen | artistic <lic>
perl | notice | under the same terms as perl | under the same terms as perl(?: itself)?
zlib | tag | spdx license identifier zlib | spdx license identifier zlib
zlib | text | in no event will the authors be held liable for any damages arising from the use of this software | in no event will the authors be held liable for any damages arising from the use of this software
zlib | text | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented
zlib | name | zlib | zlib(?: libpng)? <lic>
boost-1 | tag | spdx license identifier bsl 1 0 | spdx license identifier bsl 1 0
boost-1 | url | boost org license 1 0 | boost org license 1 0(?: txt)?
boost-1 | name | boost software licen | boost software <lic>(?: <v>1 0)?
psf | tag | spdx license identifier | spdx license identifier (?:psf|python) 2 0
psf | name | python software foundation licen | python software foundation <lic>(?: <v>2)?
psf | name | psf licen | psf <lic>
ofl-1.1 | tag | spdx license identifier ofl | spdx license identifier ofl 1 1
ofl-1.1 | url | scripts sil org ofl | scripts sil org ofl
ofl-1.1 | name | sil open font licen | sil open font <lic>(?: <v>1 1)?
ofl-1.1 | hint | open font licen | open font <lic>
eupl | tag | spdx license identifier eupl | spdx license identifier eupl 1 [012]
eupl | name | european union public licen | european union public <lic>(?: <v>1 [012])?
eupl | name | eupl | eupl <v>1 [012]
ms-pl | tag | spdx license identifier ms pl | spdx license identifier ms pl
ms-pl | name | microsoft public licen | microsoft public <lic>(?: ms pl)?
ms-rl | name | microsoft reciprocal licen | microsoft reciprocal <lic>
bsl-1.1 | tag | spdx license identifier busl | spdx license identifier busl 1 1
bsl-1.1 | name | business source licen | business source <lic>(?: <v>1 1)?
sspl-1 | tag | spdx license identifier sspl | spdx license identifier sspl 1 0
sspl-1 | name | server side public licen | server side public <lic>(?: <v>1)?
elastic-2 | name | elastic licen | elastic <lic> <v>2(?: 0)?
odbl-1 | url | opendatacommons org licenses odbl | opendatacommons org licenses odbl(?: 1 0)?
odbl-1 | name | open database licen | open database <lic>(?: odbl)?(?: <v>1 0)?
odc-by | url | opendatacommons org licenses by | opendatacommons org licenses by(?: 1 0)?
odc-by | name | open data commons attribution | open data commons attribution <lic>(?: <v>1 0)?
pddl | url | opendatacommons org licenses pddl | opendatacommons org licenses pddl(?: 1 0)?
pddl | name | public domain dedication and licen | (?:open data commons )?public domain dedication and <lic>
ogl | url | nationalarchives gov uk doc open government licence | nationalarchives gov uk doc open government licence(?: version [123])?
ogl | name | open government licen | open government <lic>(?: <v>[123](?: 0)?)?
afl-3 | name | academic free licen | academic free <lic>(?: <v>[123](?: [01])?)?
osl-3 | name | open software licen | open software <lic>(?: <v>[123](?: [01])?)?
openssl | name | openssl licen | openssl <lic>
php-3 | name | php licen | php <lic>(?: <v>3 01?)?
postgresql | name | postgresql licen | postgresql <lic>
ncsa | name | illinois ncsa open source licen | university of illinois ncsa open source <lic>
llvm | name | apache 2 0 license with llvm exceptions | apache 2 0 license with llvm exceptions
openrail | name | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: <lic>)?
gutenberg | text | project gutenberg licen | project gutenberg <lic>
gutenberg | notice | this ebook is for the use of anyone anywhere | this ebook is for the use of anyone anywhere
proprietary | text | confidential and proprietary | (?:is|are|this|strictly) confidential and proprietary
proprietary | notice | all rights reserved | copyright (?:c )?(?:<w> ){1,8}all rights reserved
proprietary | notice | may be reproduced | no part of this (?:publication|book|document|work) may be reproduced
proprietary | notice | may not be | may not be (?:reproduced|copied|redistributed) (?:<w> ){0,6}without (?:the )?(?:prior |express |written )+(?:permission|consent)
proprietary | hint | all rights reserved | all rights reserved
other | hint | open source licen | open source <lic>
other | hint | software licen | (?:this|the|our) software <lic> agreement
other | hint | end user licen | end user <lic> agreement
"""


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: str
    pattern: str
    #: Place in the table and matcher of words with a space on either side.
    place: int
    match: re.Pattern[str]


def read_rules(table: str = TABLE) -> list[Rule]:
    """The rules of a table, in its order. A pattern whose keyword holds more than plain text, or an unknown kind, is an error."""
    out = []
    for line in filter(str.strip, table.splitlines()):
        label, kind, keyword, pattern = (x.strip() for x in line.split(" | "))
        if kind not in KINDS:
            raise ValueError(f"unknown kind in {line}")
        if not re.fullmatch("[a-z0-9 ]+", keyword):
            raise ValueError(f"keywords are plain text, unlike in {line}")
        for short, full in _SHORT.items():
            pattern = pattern.replace(short, full)
        out.append(Rule(label, kind, keyword, pattern, len(out), re.compile(rf"(?<= )(?:{pattern})(?= )")))
    return out
