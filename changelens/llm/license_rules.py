"""Signature rules for license notices, headers, bodies, references and exceptions, one to a line.

label | priority | keyword | pattern, on lower-case words with single blanks.
The keyword is one or more whole words that every match holds. Texts come with
the spelling ``licence`` changed to ``license``. Notices and headers have priority 90 and above,
sentences of license bodies 80 to 89, names and links 60 to 79, weak hints less.
"""

from __future__ import annotations

# The rules.
RULES = r"""
mit | 95 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 92 | the software without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge
mit | 85 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 84 | the software is provided | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | 83 | whether in an action | whether in an action of contract tort or otherwise arising from out of or in connection with the software
mit | 72 | opensource org | opensource org licenses mit(?: license(?: php)?)?
mit | 71 | mit license | mit license mit
mit | 70 | expat | expat(?: mit)? license
mit | 70 | x11 | mit x11(?: style)? license
mit | 66 | mit style | mit style license
mit | 66 | mit licensed | (?:is|are) mit licensed
mit-0 | 88 | mit 0 | (?:license )?mit 0(?: license)?
mit-0 | 93 | mit no attribution | mit no attribution(?: license)?
mit-advertising | 82 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | 80 | x11 license | x11 license
isc | 95 | to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 88 | the author disclaims | the author disclaims all warranties with regard to this software including all implied warranties
isc | 72 | opensource org | opensource org licenses isc(?: license(?: txt)?)?
hpnd | 90 | its documentation for any purpose | permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose
ntp | 84 | this software for any purpose | it is provided as is without express or implied warranty and makes no representations about the suitability of this software for any purpose
bsd | 95 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 86 | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 86 | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | 82 | exemplary or consequential damages | liable for any direct indirect incidental special exemplary or consequential damages
bsd | 66 | bsd style | bsd style license
bsd | 66 | bsd licensed | (?:is|are) bsd licensed
bsd-1-clause | 88 | bsd 1 clause | bsd 1 clause(?: license)?
bsd-2-clause | 88 | 2 clause bsd | 2 clause bsd(?: license)?
bsd-2-clause | 88 | two clause bsd | two clause bsd(?: license)?
bsd-2-clause | 74 | opensource org | opensource org licenses bsd 2 clause
bsd-2-clause-patent | 92 | bsd 2 clause plus patent | bsd 2 clause plus patent(?: license)?
bsd-3-clause | 96 | contributors may be used to endorse | neither the names? of [^ ]+(?: [^ ]+){0,8} nor the names of (?:its|their|any)(?: [^ ]+)? contributors may be used to endorse
bsd-3-clause | 94 | neither the name | neither the name of the copyright holder nor the names of its contributors
bsd-3-clause | 88 | 3 clause bsd | 3 clause bsd(?: license)?
bsd-3-clause | 88 | three clause bsd | three clause bsd(?: license)?
bsd-3-clause | 74 | opensource org | opensource org licenses bsd 3 clause
bsd-3-clause-clear | 93 | clear bsd | clear bsd license
bsd-3-clause-clear | 86 | no express or implied licenses | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | 96 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 88 | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4-clause | 84 | original bsd | original bsd license
bsd-0-clause | 90 | 0bsd | (?:license )?0bsd
bsd-0-clause | 90 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
bsd-source-code | 80 | bsd source code | bsd source code attribution
apache-2 | 96 | apache license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 95 | apache org licenses | (?:http |https |www )*apache org licenses license 2 0(?: txt| html)?
apache-2 | 93 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | 92 | contributor license agreements | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | 90 | asf licenses this file | the asf licenses this file to you under the apache license version 2 0
apache-2 | 86 | each contributor hereby grants | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-2 | 76 | apache 2 | apache 2(?: 0)? license
apache-2 | 76 | asl 2 | asl 2(?: 0)?
apache-2 | 75 | apache license | apache license v(?:ersion )?2(?: 0)?
apache-2 | 72 | opensource org | opensource org licenses apache 2 0
apache-1.1 | 90 | this product includes software | this product includes software developed by the apache (?:group|software foundation) http www apache org
apache-1.1 | 88 | apache software license | apache software license version 1 1
apache-1 | 88 | apache software license | apache software license version 1 0
gpl-1 | 92 | gnu general public license | gnu general public license as published by the free software foundation version 1
gpl-2 | 92 | gpl 2 | gpl 2(?: 0)? only
gpl-2 | 90 | gplv2 | gplv2(?: only)?
gpl-2 | 88 | version 2 june 1991 | gnu general public license version 2 june 1991
gpl-2 | 76 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0
gpl-2-or-later | 92 | gpl 2 | gpl 2(?: 0)? or later
gpl-2-or-later | 93 | either version 2 | either version 2 of the license or at your option any later version
gpl-2-or-later | 90 | gplv2 or later | gplv2 or later
gpl-3 | 92 | gpl 3 | gpl 3(?: 0)? only
gpl-3 | 90 | gplv3 | gplv3(?: only)?
gpl-3 | 88 | version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-3 | 76 | gnu org licenses | gnu org licenses gpl 3 0
gpl-3-or-later | 92 | gpl 3 | gpl 3(?: 0)? or later
gpl-3-or-later | 93 | either version 3 | either version 3 of the license or at your option any later version
gpl-3-or-later | 90 | gplv3 or later | gplv3 or later
gpl | 95 | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 94 | free software you can redistribute | is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 86 | in the hope that it will be useful | distributed in the hope that it will be useful but without any warranty
gpl | 84 | a copy of the gnu general public license | you should have received a copy of the gnu general public license along with
gpl | 82 | freedom to share and change | the gnu general public license is intended to guarantee your freedom to share and change
gpl | 74 | gnu org copyleft | gnu org copyleft gpl(?: html)?
gpl | 72 | gnu org licenses | gnu org licenses gpl(?: html| txt)?
gpl | 66 | gpl licensed | (?:is|are) gpl licensed
gpl | 62 | gnu gpl | gnu gpl
lgpl-2 | 90 | library general public license | gnu library general public license version 2 june 1991
lgpl-2.1 | 92 | lgpl 2 1 | lgpl 2 1 only
lgpl-2.1 | 90 | lgplv2 1 | lgplv2 1(?: only)?
lgpl-2.1 | 88 | version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-2.1 | 76 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2.1-or-later | 93 | either version 2 1 | either version 2 1 of the license or at your option any later version
lgpl-2.1-or-later | 92 | lgpl 2 1 or later | lgpl 2 1 or later
lgpl-3 | 90 | lgplv3 | lgplv3(?: only)?
lgpl-3 | 92 | lgpl 3 | lgpl 3(?: 0)? only
lgpl-3 | 76 | gnu org licenses | gnu org licenses lgpl 3 0
lgpl-3-or-later | 92 | lgpl 3 | lgpl 3(?: 0)? or later
lgpl | 95 | this library is free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | 84 | gnu lesser general public license | you should have received a copy of the gnu lesser general public license along with
lgpl | 80 | a work that uses the library | a work that uses the library
lgpl | 66 | lgpl licensed | (?:is|are) lgpl licensed
agpl-3 | 92 | agpl 3 | agpl 3(?: 0)? only
agpl-3 | 90 | agplv3 | agplv3(?: only)?
agpl-3 | 88 | version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
agpl-3 | 76 | gnu org licenses | gnu org licenses agpl 3 0
agpl-3-or-later | 92 | agpl 3 | agpl 3(?: 0)? or later
agpl | 94 | gnu affero general public license | modify it under the terms of the gnu affero general public license
agpl | 84 | remote network interaction | remote network interaction use with the gnu general public license
gfdl | 90 | free documentation license | gnu free documentation license
gfdl-1.2 | 93 | free documentation license | gnu free documentation license version 1 2
gfdl-1.3 | 93 | free documentation license | gnu free documentation license version 1 3
gfdl | 88 | no invariant sections | with no invariant sections no front cover texts and no back cover texts
classpath-exception | 90 | classpath exception | (?:with the |gpl )?(?:2 0 )?classpath exception(?: 2 0)?
classpath-exception | 92 | independent modules | permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules
gcc-exception | 90 | runtime library exception | gcc runtime library exception(?: version 3 1)?
autoconf-exception | 90 | configure script | you may distribute a configure script generated by autoconf under terms of your choice
bison-exception | 90 | bison parser | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
font-exception | 88 | embed this font | if you create a document which uses this font and embed this font
openssl-exception | 90 | openssl library | permission to link the code of (?:portions of )?this program with the openssl library
llvm-exception | 90 | llvm exceptions | (?:apache license v2 0 )?with llvm exceptions
linux-syscall-note | 92 | linux syscall note | with linux syscall note
linking-exception | 86 | linking this library | linking this library statically or dynamically with other modules is making a combined work based on this library
mpl-1 | 88 | mozilla public license | mozilla public license version 1 0
mpl-1.1 | 94 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | 76 | mozilla org mpl | mozilla org mpl mpl 1 1(?: html)?
mpl-2 | 96 | this source code form | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-2 | 92 | mozilla org mpl | if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?mozilla org mpl 2 0
mpl-2 | 76 | mozilla org | mozilla org (?:en us )?mpl 2 0
mpl-2-no-copyleft-exception | 93 | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
npl-1.1 | 90 | netscape public license | netscape public license version 1 1
epl-1 | 94 | eclipse public license | terms of the eclipse public license v(?:ersion )?1 0
epl-2 | 94 | eclipse public license | terms of the eclipse public license(?: version)? v?2 0
epl-1 | 76 | eclipse org | eclipse org legal epl v10(?: html)?
epl-2 | 76 | eclipse org | eclipse org legal epl 2 0
edl-1 | 88 | eclipse distribution license | eclipse distribution license v(?:ersion )?1 0
cpl-1 | 88 | common public license | common public license(?: version)? v?1 0
ipl-1 | 88 | ibm public license | ibm public license(?: version 1 0)?
cddl-1 | 92 | common development and distribution license | terms of the common development and distribution license
cddl-1 | 88 | cddl version 1 | cddl version 1 0
cddl-1.1 | 88 | cddl version 1 | cddl version 1 1
eupl-1.1 | 88 | european union public | european union public licen[sc]e v(?:ersion )?1 1
eupl-1.2 | 90 | eupl | licensed under the eupl version 1 2
eupl-1.2 | 88 | european union public | european union public license v(?:ersion )?1 2
eupl | 86 | eupl | licensed under the eupl
cecill-2.1 | 88 | cecill | cecill (?:free software license agreement )?version 2 1
cecill | 82 | cecill | governed by the cecill(?: b| c)? license
osl-3 | 88 | open software license | open software license(?: version)? v?3 0
afl-3 | 88 | academic free license | academic free license(?: version)? v?3 0
afl-2.1 | 88 | academic free license | academic free license(?: version)? v?2 1
ms-pl | 88 | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | 88 | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
apsl-2 | 88 | apple public source license | apple public source license(?: version)? 2 0
artistic-1 | 86 | artistic license | artistic license 1 0
artistic-2 | 88 | artistic license | artistic license(?: version)? 2 0
artistic | 84 | same terms as perl | under the same terms as perl(?: itself| 5)?
python-2 | 90 | python software foundation license | python software foundation license(?: version)? 2
python-2 | 88 | psf license agreement | psf license agreement for python
ruby | 86 | ruby | ruby (?:s )?license
php-3.01 | 90 | php license | version 3 0?1 of the php license
php-3.01 | 84 | php license | php license version 3 0?1
zend-2 | 86 | zend license | zend license version 2 0
zlib | 94 | this software is provided | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 88 | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 87 | the origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | 88 | png reference library | png reference library(?: license)?(?: version 2)?
bsl-1 | 95 | covered by this license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1 | 92 | boost software license | distributed under the boost software license version 1 0
bsl-1 | 76 | boost org | boost org license 1 0 txt
busl-1.1 | 92 | business source license | business source license 1 1
busl-1.1 | 86 | change date | on the change date or the fourth anniversary of the first publicly available distribution
sspl-1 | 92 | server side public license | server side public license(?: version)? v?1
elastic-2 | 92 | elastic license | elastic license 2 0
elastic-2 | 86 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | 92 | commons clause | commons clause license condition v1 0
confluent-1 | 88 | confluent community license | confluent community license(?: agreement)?(?: version 1 0)?
polyform-noncommercial | 88 | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
polyform-shield | 88 | polyform shield | polyform shield license(?: 1 0 0)?
prosperity | 86 | prosperity public license | prosperity public license(?: 3 0 0)?
parity | 86 | parity public license | parity public license(?: 7 0 0)?
unlicense | 95 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 88 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 76 | unlicense org | (?:http |https )?unlicense org
wtfpl-2 | 95 | everyone is permitted | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
wtfpl-2 | 88 | you just do | you just do what the fuck you want to
beerware | 92 | beer ware license | the beer ware license(?: revision 42)?
beerware | 90 | buy me a beer | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 92 | for good not evil | the software shall be used for good not evil
postgresql | 90 | postgresql license | postgresql license
curl | 88 | curl license | curl license
openssl | 94 | the openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 92 | eric young | this product includes cryptographic software written by eric young
openldap-2.8 | 88 | openldap public license | openldap public license version 2 8
w3c | 90 | w3c software | w3c software (?:notice and )?(?:and document )?license
unicode | 90 | unicode license | unicode license(?: v3| agreement data files and software)?
icu | 86 | icu license | icu license(?: icu 1 8 1 and later)?
ncsa | 90 | open source license | university of illinois(?: ncsa)? open source license
upl-1 | 90 | universal permissive license | universal permissive license(?: version)? v?1 0
blueoak-1 | 90 | blue oak model license | blue oak model license 1 0 0
mulan-2 | 90 | mulan psl | mulan psl v2
mulan-2 | 90 | mulan permissive | mulan permissive software license v(?:ersion )?2
vim | 86 | vim license | vim license
tcl | 86 | tcl license | tcl license
tcl | 86 | tcl tk | tcl tk license
qpl-1 | 88 | q public license | q public license version 1 0
sleepycat | 86 | sleepycat | sleepycat (?:public )?license
sgi-b-2 | 88 | sgi free software license b | sgi free software license b(?: version 2 0)?
watcom | 84 | sybase open watcom | sybase open watcom public license
intel | 84 | intel open source license | intel open source license
nvidia | 82 | nvidia software license | nvidia software license(?: agreement)?
oracle-bcl | 82 | binary code license | oracle binary code license(?: agreement)?
ofl-1.1 | 95 | sil open font license | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 88 | font software | the font software may be sold as part of a larger software package
ofl | 78 | scripts sil org | scripts sil org ofl
ofl | 80 | with reserved font | with reserved font names?
ubuntu-font-1 | 88 | ubuntu font | ubuntu font licen[sc]e version 1 0
gust-font | 84 | gust font license | gust font license
odbl-1 | 92 | open database license | (?:made available|licensed) under the open database license
odbl-1 | 76 | opendatacommons org | opendatacommons org licenses odbl 1 0
odc-by-1 | 76 | opendatacommons org | opendatacommons org licenses by 1 0
odc-by-1 | 88 | open data commons attribution | open data commons attribution license(?: v1 0)?
pddl-1 | 88 | public domain dedication | (?:open data commons )?public domain dedication (?:and )?license
pddl-1 | 76 | opendatacommons org | opendatacommons org licenses pddl 1 0
cdla-permissive-2 | 88 | community data license agreement | community data license agreement permissive(?: version)? 2 0
cdla-sharing-1 | 88 | community data license agreement | community data license agreement sharing(?: version)? 1 0
ogl-3 | 88 | open government license | open government licen[sc]e v(?:ersion )?3 0
ogl | 82 | open government license | open government licen[sc]e
cc-by-4 | 90 | creative commons attribution 4 | creative commons attribution 4 0 international(?: public)?(?: license)?
cc-by-3 | 90 | creative commons attribution 3 | creative commons attribution 3 0 (?:unported|united states|generic)(?: license)?
cc-by-sa-4 | 92 | sharealike 4 | creative commons attribution sharealike 4 0 international(?: public)?(?: license)?
cc-by-sa-3 | 92 | sharealike 3 | creative commons attribution sharealike 3 0 (?:unported|united states|generic)(?: license)?
cc-by-nd-4 | 92 | noderivatives 4 | creative commons attribution noderivatives 4 0 international(?: public)?(?: license)?
cc-by-nc-4 | 92 | noncommercial 4 | creative commons attribution noncommercial 4 0 international(?: public)?(?: license)?
cc-by-nc-sa-4 | 94 | noncommercial sharealike 4 | creative commons attribution noncommercial sharealike 4 0 international(?: public)?(?: license)?
cc-by-nc-nd-4 | 94 | noncommercial noderivatives 4 | creative commons attribution noncommercial noderivatives 4 0 international(?: public)?(?: license)?
cc-by | 76 | creativecommons org | creativecommons org licenses by(?: [1-4] 0)?
cc-by-sa | 78 | creativecommons org | creativecommons org licenses by sa(?: [1-4] 0)?
cc-by-nd | 78 | creativecommons org | creativecommons org licenses by nd(?: [1-4] 0)?
cc-by-nc | 78 | creativecommons org | creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-nc-sa | 79 | creativecommons org | creativecommons org licenses by nc sa(?: [1-4] 0)?
cc-by-nc-nd | 79 | creativecommons org | creativecommons org licenses by nc nd(?: [1-4] 0)?
cc0-1 | 78 | creativecommons org | creativecommons org publicdomain zero 1 0
cc0-1 | 90 | cc0 1 0 | cc0 1 0(?: universal)?
cc0-1 | 92 | waived all copyright | has waived all copyright and related or neighboring rights
public-domain | 78 | creativecommons org | creativecommons org publicdomain mark 1 0
public-domain | 70 | public domain | this (?:file|code|software|work|program) is (?:hereby )?(?:placed )?in the public domain
public-domain | 68 | public domain | (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
public-domain | 66 | disclaims copyright | the author disclaims copyright to this source code
dual | 72 | dual licensed | dual licensed under
dual | 72 | under either of | licensed under either of
dual | 70 | at your option | (?:mit|apache|gpl|bsd|mpl)(?: license)?(?: 2 0)? or (?:the )?(?:mit|apache|gpl|bsd|mpl)(?: license)?(?: version)?(?: 2 0)? at your option
dual | 68 | choice of license | your choice of license
dual | 68 | you may choose | you may choose (?:either|which) license
dual | 65 | dually licensed | dually licensed
dual | 65 | dual licensed | dual licensed
linking-exception | 70 | linking exception | (?:static )?linking exception
llvm-exception | 84 | llvm exception | llvm exception
linking-exception | 88 | as a special exception | as a special exception the copyright holders? [^ ]+(?: [^ ]+){0,8} give you permission to link
proprietary | 40 | proprietary and confidential | proprietary and confidential
proprietary | 20 | all rights reserved | all rights reserved
openrail | 88 | openrail | (?:creativeml |bigscience )?(?:bloom )?openrail(?: m)?(?: license)?
llama-community | 88 | community license agreement | llama [0-9](?: [0-9])? community license agreement
gemma | 84 | terms of use | gemma terms of use
research-only | 64 | research purposes only | (?:for )?(?:non commercial )?research purposes only
evaluation-only | 62 | evaluation purposes only | (?:for )?evaluation purposes only
non-commercial | 64 | commercial use | (?:not for|no) commercial use
non-commercial | 62 | non commercial | for non commercial (?:use|purposes)(?: only)?
non-commercial | 60 | use only | for personal(?: non commercial)? use only
no-derivatives | 60 | derivative works | no derivative works(?: are)?(?: permitted| allowed)?
educational-only | 60 | educational use only | (?:for )?educational use only
proprietary | 66 | information and trade | contains? (?:confidential|proprietary)(?: and (?:confidential|proprietary))? information and trade secrets?
proprietary | 64 | strictly prohibited | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)(?: [^ ]+){0,6} is strictly prohibited
proprietary | 64 | written permission | may not be (?:copied|reproduced|distributed|used)(?: [^ ]+){0,8} without (?:the )?(?:(?:prior|express|explicit) )?written permission
proprietary | 62 | end user license agreement | end user license agreement
proprietary | 60 | license key | requires a valid license key
"""


def lines() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority) of every line."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ")
        out.append((label, keyword, pattern.replace("licen[sc]e", "license"), int(priority)))
    return out
