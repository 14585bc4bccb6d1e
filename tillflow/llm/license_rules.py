"""Signature rules of the license scan, in the order in which they are applied.

A rule reads words, lower-cased and with one blank between them; everything that is
not a letter or digit separates words, so "Apache-2.0" is ``apache 2 0``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What a rule of each tier says about the license, from identifier to hint.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.4}


@dataclass(frozen=True)
class Rule:
    """``keyword`` is a word without which the rule cannot match; a smaller ``tier`` wins.

    ``lead`` has to stand before ``pattern`` and is not part of the detection.
    """

    label: str
    tier: int
    keyword: str
    pattern: str
    base: bool = False
    lead: str = ""

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.tier]


#: Fixed by the contract: the base phrases and their labels.
BASE = (
    Rule("mit", 3, "mit", "mit license", True),
    Rule("apache", 3, "apache", "apache license", True),
    Rule("gpl", 3, "general", "general public license", True),
)

#: label | tier | keyword | pattern
_SIGNATURES = r"""
mit | 1 | sublicense | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction(?: [^ ]+){0,24} sublicense
mit | 1 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | mit | the mit licen[cs]e(?: mit)?
mit | 2 | mit | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: x11)?(?: licen[cs]e)?
mit | 2 | opensource | (?:https? )?(?:www )?opensource org licenses? mit(?: license(?: php| html)?)?
mit | 3 | expat | expat licen[cs]e
mit | 3 | x11 | (?:mit )?x11 licen[cs]e
mit | 3 | mit | mit style licen[cs]e
mit-0 | 2 | mit | mit no attribution(?: licen[cs]e)?
mit-0 | 2 | mit | mit 0 licen[cs]e
apache-2.0 | 1 | apache | licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license
apache-2.0 | 1 | apache | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | 2 | apache | (?:the )?apache(?: software)? licen[cs]e(?: version| v)? (?:2 0|2|v2 0|v2)
apache-2.0 | 2 | apache | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 2 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache (?:2 0|2|v2|v2 0)
apache-2.0 | 3 | apache | apache (?:2 0|v2 0|v2)
apache-2.0 | 3 | asl | asl (?:2 0|v2 0|v2)
apache-2.0 | 3 | al2 | licen[cs]e al2(?: 0)?
apache-2.0 | 4 | apache | apache style licen[cs]e
apache-1.1 | 2 | apache | (?:the )?apache(?: software)? licen[cs]e version 1 1
apache-1.1 | 2 | apache | (?:https? )?(?:www )?apache org licenses license 1 1
apache-1.0 | 2 | apache | (?:the )?apache(?: software)? licen[cs]e version 1 0
apache-1.0 | 2 | apache | (?:https? )?(?:www )?apache org licenses license 1 0
gpl-3.0-or-later | 1 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-3.0-or-later | 2 | general | gnu general public licen[cs]e(?: gpl)? version 3 or(?: at your option)? (?:any )?later(?: version)?
gpl-3.0-or-later | 3 | gplv3 | gplv3 or later
gpl-3.0-or-later | 3 | gpl | gpl v?3(?: 0)? or later
gpl-3.0 | 2 | general | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? (?:3|v3)(?: 0)?
gpl-3.0 | 2 | gnu | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-3.0 | 2 | opensource | (?:https? )?(?:www )?opensource org licenses? gpl 3 0
gpl-3.0 | 3 | gpl | (?:gnu )?gpl (?:version )?v?3(?: 0)?
gpl-3.0 | 3 | gplv3 | (?:gnu )?gplv3
gpl-3.0 | 3 | gpl3 | (?:gnu )?gpl3
gpl-2.0-or-later | 1 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-2.0-or-later | 2 | general | gnu general public licen[cs]e(?: gpl)? version 2 or(?: at your option)? (?:any )?later(?: version)?
gpl-2.0-or-later | 3 | gplv2 | gplv2 or later
gpl-2.0-or-later | 3 | gpl | gpl v?2(?: 0)? or later
gpl-2.0 | 1 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation
gpl-2.0 | 2 | general | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? (?:2|v2)(?: 0)?
gpl-2.0 | 2 | gnu | (?:https? )?(?:www )?gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?
gpl-2.0 | 2 | opensource | (?:https? )?(?:www )?opensource org licenses? gpl 2 0
gpl-2.0 | 3 | gpl | (?:gnu )?gpl (?:version )?v?2(?: 0)?
gpl-2.0 | 3 | gplv2 | (?:gnu )?gplv2
gpl-2.0 | 3 | gpl2 | (?:gnu )?gpl2
gpl-2.0-classpath | 2 | classpath | (?:gnu general public licen[cs]e version 2|gplv2|gpl 2 0|gpl v2) with(?: the)? classpath exception
gpl-1.0 | 2 | general | (?:gnu )?general public licen[cs]e(?: gpl)? version 1(?: 0)?
gpl | 2 | gnu | (?:the )?gnu general public licen[cs]e
gpl | 2 | copying | you should have received a copy of the gnu general public licen[cs]e along with this (?:program|package|library|file|software)(?: [^ ]+){0,6} copying
gpl | 2 | received | you should have received a copy of the gnu general public licen[cs]e along with this (?:program|package|library|file|software)
gpl | 3 | gnu | gnu gpl
gpl | 3 | gpl | (?:under|the) (?:the )?gpl
gpl | 4 | gpl | gpl compatible
lgpl-3.0-or-later | 1 | lesser | under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: 0)? of the license or(?: at your option)? any later version
lgpl-3.0 | 2 | lesser | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? (?:3|v3)(?: 0)?
lgpl-3.0 | 2 | lgpl | (?:https? )?(?:www )?gnu org licenses lgpl 3 0
lgpl-3.0 | 3 | lgpl | (?:gnu )?lgpl (?:version )?v?3(?: 0)?
lgpl-3.0 | 3 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1-or-later | 1 | lesser | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-2.1 | 2 | lesser | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? (?:2 1|v2 1)
lgpl-2.1 | 2 | lgpl | (?:https? )?(?:www )?gnu org licenses(?: old licenses)? lgpl 2 1
lgpl-2.1 | 3 | lgpl | (?:gnu )?lgpl (?:version )?v?2 1
lgpl-2.1 | 3 | lgplv2 | (?:gnu )?lgplv2 1
lgpl-2.0 | 2 | library | (?:gnu )?library general public licen[cs]e(?: lgpl)?(?: version| v)? (?:2|v2)(?: 0)?
lgpl-2.0 | 3 | lgpl | (?:gnu )?lgpl (?:version )?v?2 0
lgpl | 2 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | 2 | library | gnu library general public licen[cs]e
lgpl | 3 | lgpl | (?:gnu )?lgpl
agpl-3.0-or-later | 1 | affero | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl-3.0 | 2 | affero | (?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version| v)? (?:3|v3)(?: 0)?
agpl-3.0 | 2 | agpl | (?:https? )?(?:www )?gnu org licenses agpl 3 0
agpl-3.0 | 3 | agpl | (?:gnu )?agpl (?:version )?v?3(?: 0)?
agpl-3.0 | 3 | agplv3 | (?:gnu )?agplv3
agpl-1.0 | 2 | affero | affero general public licen[cs]e version 1(?: 0)?
agpl | 2 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 3 | agpl | (?:gnu )?agpl
gfdl-1.3 | 2 | documentation | gnu free documentation licen[cs]e(?: gfdl)? version 1 3
gfdl-1.2 | 2 | documentation | gnu free documentation licen[cs]e(?: gfdl)? version 1 2
gfdl-1.1 | 2 | documentation | gnu free documentation licen[cs]e(?: gfdl)? version 1 1
gfdl | 2 | documentation | (?:gnu )?free documentation licen[cs]e
gfdl | 3 | gfdl | (?:gnu )?gfdl
bsd-3-clause | 1 | endorse | neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 2 | bsd | (?:the )?(?:bsd )?3 clause bsd(?: licen[cs]e)?
bsd-3-clause | 2 | bsd | bsd 3 clause(?: new or revised)?(?: licen[cs]e)?
bsd-3-clause | 2 | bsd | (?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-3-clause | 2 | bsd | (?:https? )?(?:www )?opensource org licenses? bsd 3 clause
bsd-2-clause | 1 | redistributions | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | 2 | bsd | (?:the )?2 clause bsd(?: licen[cs]e)?
bsd-2-clause | 2 | bsd | bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-2-clause | 2 | bsd | (?:simplified|freebsd) bsd(?: licen[cs]e)?
bsd-2-clause | 2 | bsd | (?:https? )?(?:www )?opensource org licenses? bsd 2 clause
bsd-2-clause | 3 | freebsd | (?:the )?freebsd licen[cs]e
bsd-4-clause | 1 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 2 | bsd | (?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
bsd-1-clause | 2 | bsd | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
0bsd | 2 | 0bsd | 0bsd(?: licen[cs]e)?
0bsd | 2 | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 2 | bsd | (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[cs]e)?
bsd | 3 | bsd | bsd(?: style)? licen[cs]e
isc | 1 | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: [^ ]+){0,24} isc
isc | 1 | granted | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | (?:the )?isc licen[cs]e
isc | 2 | isc | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc
isc | 2 | opensource | (?:https? )?(?:www )?opensource org licenses? isc
mpl-2.0 | 1 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 2 | mozilla | mozilla public licen[cs]e(?: mpl)?(?: version| v)? (?:2 0|2)
mpl-2.0 | 2 | mozilla | (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-2.0 | 3 | mpl | mpl (?:version )?v?2(?: 0)?
mpl-2.0 | 3 | mplv2 | mplv2(?: 0)?
mpl-1.1 | 1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | 2 | mozilla | mozilla public licen[cs]e(?: mpl)?(?: version| v)? 1 1
mpl-1.1 | 3 | mpl | mpl (?:version )?v?1 1
mpl-1.0 | 2 | mozilla | mozilla public licen[cs]e(?: mpl)?(?: version| v)? 1 0
mpl | 2 | mozilla | mozilla public licen[cs]e
npl-1.1 | 2 | netscape | netscape public licen[cs]e version 1 1
npl | 2 | netscape | netscape public licen[cs]e
epl-2.0 | 1 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0
epl-2.0 | 2 | eclipse | eclipse public licen[cs]e(?: version| v)? (?:2 0|2)
epl-2.0 | 2 | eclipse | (?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)
epl-2.0 | 3 | epl | epl v?2 0
epl-1.0 | 2 | eclipse | eclipse public licen[cs]e(?: version| v)? (?:1 0|1)
epl-1.0 | 2 | eclipse | (?:https? )?(?:www )?eclipse org legal epl v10
epl-1.0 | 3 | epl | epl v?1 0
epl | 2 | eclipse | eclipse public licen[cs]e
edl-1.0 | 2 | eclipse | eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?
cddl-1.1 | 2 | cddl | cddl(?: version| v)? 1 1
cddl-1.1 | 2 | development | common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 1
cddl-1.0 | 2 | cddl | cddl(?: version| v)? 1 0
cddl-1.0 | 2 | development | common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 0
cddl | 2 | development | common development and distribution licen[cs]e
cddl | 3 | cddl | cddl
cpl-1.0 | 2 | common | common public licen[cs]e(?: version| v)?(?: 1 0)?
cpal-1.0 | 2 | attribution | common public attribution licen[cs]e(?: version| v)?(?: 1 0)?
ipl-1.0 | 2 | ibm | ibm public licen[cs]e(?: version| v)?(?: 1 0)?
osl-3.0 | 2 | open | open software licen[cs]e(?: version| v)? 3 0
osl-2.1 | 2 | open | open software licen[cs]e(?: version| v)? 2 1
afl-3.0 | 2 | academic | academic free licen[cs]e(?: version| v)? 3 0
afl-2.1 | 2 | academic | academic free licen[cs]e(?: version| v)? 2 1
afl | 2 | academic | academic free licen[cs]e
eupl-1.2 | 2 | european | european union public licen[cs]e(?: eupl)?(?: version| v)? 1 2
eupl-1.2 | 2 | eupl | eupl(?: version| v)? 1 2
eupl-1.1 | 2 | european | european union public licen[cs]e(?: eupl)?(?: version| v)? 1 1
eupl-1.1 | 2 | eupl | eupl(?: version| v)? 1 1
eupl | 2 | european | european union public licen[cs]e
cecill-2.1 | 2 | cecill | cecill(?: free software licen[cs]e)?(?: agreement)?(?: version| v)? 2 1
cecill-b | 2 | cecill | cecill b
cecill-c | 2 | cecill | cecill c
cecill | 3 | cecill | cecill(?: licen[cs]e)?
artistic-2.0 | 2 | artistic | (?:the )?artistic licen[cs]e(?: version| v)? 2(?: 0)?
artistic-1.0 | 2 | artistic | (?:the )?artistic licen[cs]e(?: version| v)? 1(?: 0)?
artistic | 3 | artistic | (?:the )?(?:perl )?artistic licen[cs]e
perl | 2 | perl | under the same terms as perl(?: itself)?
zlib | 1 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 1 | implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | 2 | zlib | zlib(?: libpng)? licen[cs]e
libpng | 2 | libpng | libpng licen[cs]e
libpng | 2 | png | png reference library licen[cs]e
bsl-1.0 | 1 | boost | distributed under the boost software license version 1 0
bsl-1.0 | 2 | boost | boost software licen[cs]e(?: version| v)?(?: 1 0)?
bsl-1.0 | 2 | boost | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
busl-1.1 | 2 | business | business source licen[cs]e(?: version| v)?(?: 1 1)?
sspl-1.0 | 2 | side | server side public licen[cs]e(?: version| v)?(?: 1)?
sspl-1.0 | 3 | sspl | sspl(?: v?1)?
elastic-2.0 | 2 | elastic | elastic licen[cs]e(?: version| v)? 2(?: 0)?
elastic | 3 | elastic | elastic licen[cs]e
commons-clause | 2 | clause | commons clause(?: licen[cs]e)?(?: condition)?(?: v?1 0)?
polyform-noncommercial | 2 | polyform | polyform noncommercial licen[cs]e
polyform-small-business | 2 | polyform | polyform small business licen[cs]e
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (?:the )?unlicense(?: org)?
wtfpl | 2 | wtfpl | (?:the )?wtfpl
wtfpl | 2 | fuck | do what the fuck you want to public licen[cs]e
beerware | 2 | beer | (?:the )?beer ware licen[cs]e
beerware | 2 | beerware | (?:the )?beerware(?: licen[cs]e)?
cc0-1.0 | 1 | waived | to the extent possible under law(?: [^ ]+){1,16} has waived all copyright and related or neighboring rights
cc0-1.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
cc0-1.0 | 2 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 2 | creative | creative commons zero(?: v?1 0)?(?: universal)?
cc-pdm-1.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
cc-by-4.0 | 2 | cc | cc by 4 0
cc-by-4.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by 4 0
cc-by-4.0 | 2 | creative | creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-3.0 | 2 | cc | cc by 3 0
cc-by-3.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by 3 0
cc-by-3.0 | 2 | creative | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
cc-by-2.0 | 2 | cc | cc by 2 [05]
cc-by | 3 | cc | cc by
cc-by | 3 | creative | creative commons attribution(?: licen[cs]e)?
cc-by-sa-4.0 | 2 | cc | cc by sa 4 0
cc-by-sa-4.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by sa 4 0
cc-by-sa-4.0 | 2 | creative | creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-sa-3.0 | 2 | cc | cc by sa 3 0
cc-by-sa-3.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by sa 3 0
cc-by-sa-3.0 | 2 | creative | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-sa | 3 | cc | cc by sa
cc-by-sa | 3 | creative | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nc-4.0 | 2 | cc | cc by nc 4 0
cc-by-nc-4.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | 2 | creative | creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-3.0 | 2 | cc | cc by nc 3 0
cc-by-nc | 3 | cc | cc by nc
cc-by-nc | 3 | creative | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nd-4.0 | 2 | cc | cc by nd 4 0
cc-by-nd-4.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nd 4 0
cc-by-nd | 3 | cc | cc by nd
cc-by-nd | 3 | creative | creative commons attribution no ?derivatives(?: licen[cs]e)?
cc-by-nc-sa-4.0 | 2 | cc | cc by nc sa 4 0
cc-by-nc-sa-4.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 | 2 | creative | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-sa-3.0 | 2 | cc | cc by nc sa 3 0
cc-by-nc-sa | 3 | cc | cc by nc sa
cc-by-nc-nd-4.0 | 2 | cc | cc by nc nd 4 0
cc-by-nc-nd-4.0 | 2 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 | 2 | creative | creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-nd | 3 | cc | cc by nc nd
creative-commons | 3 | creative | creative commons(?: public)? licen[cs]e
creative-commons | 4 | creativecommons | creativecommons org licenses
odbl-1.0 | 2 | database | open database licen[cs]e(?: odbl)?(?: version| v)?(?: 1 0)?
odbl-1.0 | 3 | odbl | odbl(?: v?1 0)?
odc-by-1.0 | 2 | commons | open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)?
pddl-1.0 | 2 | domain | (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive-2.0 | 2 | cdla | cdla permissive(?: v?2 0)?
cdla-permissive-2.0 | 2 | community | community data licen[cs]e agreement permissive
cdla-sharing-1.0 | 2 | community | community data licen[cs]e agreement sharing
ofl-1.1 | 1 | ofl | this font software is licensed under the sil open font license version 1 1(?: [^ ]+){0,24} ofl
ofl-1.1 | 2 | sil | sil open font licen[cs]e(?: ofl)?(?: version| v)?(?: 1 1)?
ofl-1.1 | 2 | ofl | (?:scripts )?sil org ofl
python-2.0 | 2 | python | python software foundation licen[cs]e(?: version| v)?(?: 2)?
python-2.0 | 3 | psf | psf licen[cs]e(?: agreement)?
php-3.01 | 2 | php | php licen[cs]e(?: version| v)? 3 01
php | 3 | php | (?:the )?php licen[cs]e
ruby | 2 | ruby | (?:the )?ruby licen[cs]e
openssl | 1 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 2 | openssl | openssl licen[cs]e
curl | 2 | curl | curl licen[cs]e
ncsa | 2 | illinois | university of illinois(?: ncsa)? open source licen[cs]e
ncsa | 3 | ncsa | ncsa(?: open source)? licen[cs]e
postgresql | 2 | postgresql | (?:the )?postgresql licen[cs]e
w3c | 2 | w3c | w3c software(?: notice)?(?: and)?(?: document)? licen[cs]e
unicode-dfs | 2 | unicode | unicode(?: inc)? licen[cs]e(?: agreement)?
icu | 2 | icu | icu licen[cs]e
ms-pl | 2 | microsoft | microsoft public licen[cs]e(?: ms pl)?
ms-rl | 2 | microsoft | microsoft reciprocal licen[cs]e(?: ms rl)?
upl-1.0 | 2 | universal | universal permissive licen[cs]e(?: upl)?(?: version| v)?(?: 1 0)?
vim | 2 | vim | vim licen[cs]e
sleepycat | 2 | sleepycat | sleepycat(?: public)? licen[cs]e
ecl-2.0 | 2 | educational | educational community licen[cs]e(?: version| v)?(?: 2 0)?
qpl-1.0 | 2 | qpl | (?:the )?qpl(?: version| v)?(?: 1 0)?
json | 1 | evil | the software shall be used for good not evil
llama-community | 2 | llama | llama (?:2|3|3 1|3 2|3 3|4) community licen[cs]e(?: agreement)?
openrail | 2 | openrail | (?:creativeml )?openrail(?: m)?(?: licen[cs]e)?
openrail | 2 | rail | (?:bigscience )?(?:bloom )?(?:open )?rail(?: m)?(?: 1 0)? licen[cs]e
gemma | 2 | gemma | gemma terms of use
public-domain | 2 | domain | (?:released|placed|dedicated|is) (?:into|in|to) the public domain
public-domain | 4 | domain | public domain
proprietary | 2 | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | 2 | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: or [^ ]+)?(?: of this (?:file|software|document|work|material))?(?: via any medium)? is strictly prohibited
proprietary | 3 | reproduced | no part of this (?:publication|book|work|document) may be reproduced
all-rights-reserved | 3 | reserved | all rights reserved
copyright | 4 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
copyleft | 4 | copyleft | copyleft
"""

#: Identifiers as they stand after "SPDX-License-Identifier:"; a rule each.
_SPDX = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1
Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0
CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0
ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ICU IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.0 MPL-1.1
MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 ODC-By-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.01
PostgreSQL Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL Zlib
"""


def _words(identifier: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", identifier.lower()))


def _spdx(identifier: str) -> Rule:
    """Also where the identifier stands later in an expression such as "MIT OR Zlib"."""
    lead = "spdx license identifier (?:[^ ]+ ){0,12}?"
    return Rule(identifier.lower(), 1, "spdx", _words(identifier), lead=lead)


def _signature(line: str) -> Rule:
    label, tier, keyword, pattern = (part.strip() for part in line.split(" | "))
    return Rule(label, int(tier), keyword, pattern)


RULES: tuple[Rule, ...] = (
    *BASE,
    *map(_spdx, _SPDX.split()),
    *map(_signature, _SIGNATURES.strip().splitlines()),
)
