"""Hand-written license signatures, by section: priority, confidence, and lines of "label: expression".

An expression is a regular expression over lower-case words with one space between them; punctuation counts as a
space ("GPL-2.0+" is "gpl 2 0", "author's" is "author s"). Its first word is plain, as rules are looked up by it.
Optional parts are (?:...)?, alternatives (?:a|b); a match ends at a word's end.
"""

from __future__ import annotations

#: Sentences of license texts and notices.
NOTICES = """
mit: permission is hereby granted free of charge to any person obtaining a copy
mit: deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit: copies or substantial portions of the software
mit: permit persons to whom the software is furnished to do so
mit-0: permit persons to whom the software is furnished to do so the software is provided as is
mit-modern: permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is
hpnd: permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
ntp: permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
x11: shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions in binary form must reproduce the above copyright notice
bsd-3: neither the name(?:s)? of (?:the )?(?:copyright holder(?:s)?|author|university|company|organization)(?: nor the names of its contributors)? may be used to endorse or promote products
bsd-3: endorse or promote products derived from this software without specific prior written permission
bsd-4: all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-uc: includes software developed by the university of california berkeley and its contributors
bsd-2-patent: contributors provides a patent license under licensed patents
apache-1: redistributions of any form whatsoever must retain the following acknowledg(?:e)?ment
apache-1-1: includes software developed by the apache software foundation
apache-2: you may not use this file except in compliance with the license
apache-2: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2: limitations under the license
apache-2: grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2: licensed to the apache software foundation asf under one or more contributor license agreements
apache-2: legal entity shall mean the union of the acting entity
gpl: free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl: licenses for most software are designed to take away your freedom to share and change it
gpl: should have received a copy of the gnu general public license along with this program
gpl-2: gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2: gnu general public license version 2 as published by the free software foundation
gpl-3: gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3: gnu general public license version 3 as published by the free software foundation
gpl-3: free copyleft license for software and other kinds of works
lgpl: free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2-1: gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-2: gnu library general public license as published by the free software foundation either version 2 of the license
lgpl-3: gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl: incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions
agpl-3: gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3: users interacting with it remotely through a computer network
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl: invariant sections no front cover texts and no back cover texts
gcc-exception: linking this library statically or dynamically with other modules is making a combined work
classpath-exception: special exception the copyright holders of this library give you permission to link this library with independent modules
autoconf-exception: special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script
bison-exception: special exception you may create a larger work that contains part or all of the bison parser skeleton
openssl-exception: special exception the copyright holders give permission to link the code of portions of this program with the openssl library
mpl-1-1: contents of this file are subject to the mozilla public license version 1 1
mpl-1: contents of this file are subject to the mozilla public license version 1 0
mpl-2: source code form is subject to the terms of the mozilla public license v 2 0
mpl-2: incompatible with secondary licenses as defined by the mozilla public license
npl-1-1: contents of this file are subject to the netscape public license version 1 1
cddl-1: contents of this file are subject to the terms of the common development and distribution license
epl-1: accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2: accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cpl-1: accompanying materials are made available under the terms of the common public license v1 0
edl-1: accompanying materials are made available under the terms of the eclipse distribution license v1 0
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib: origin of this software must not be misrepresented
libpng: png reference library is supplied as is
boost-1: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense: free and unencumbered software released into the public domain
cc0: waives (?:all|any) copyright and related (?:and|or) neighboring rights
cc0: dedicate any and all copyright interest in the software to the public domain
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document
wtfpl: do what the fuck you want to public license
beerware: buy me a beer in return
artistic-1: intent of this document is to state the conditions under which a package may be copied
artistic-2: copyright holder intends that you have the right to copy modify and distribute the package
perl: same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)? itself
python-2: psf is making python available to licensee on an as is basis
python-2: psf hereby grants licensee a nonexclusive royalty free world wide license
php-3: includes php software freely available from
ruby: you may make and give away verbatim copies of the source form of the software without restriction
openssl: includes software developed by the openssl project for use in the openssl toolkit
ssleay: includes cryptographic software written by eric young
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
icu: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode: copyright (?:c )?1991 (?:19|20)[0-9]{2} unicode inc
ofl: font software may be sold as part of a larger software package but no copy of one or more of the font software
ofl: font software is licensed under the sil open font license version 1 1
odbl: database is made available under the open database license
odc-by: database is made available under the open data commons attribution license
pddl: database is made available under the public domain dedication and license
w3c: permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted
ms-pl: grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution
ms-rl: code that you distribute that contains code from the software you must provide recipients the source code
afl-3: licensed under the academic free license version 3 0
osl-3: licensed under the open software license version 3 0
eupl: licensed under the eupl(?: version)? 1 [12]
upl: permission is hereby granted free of charge subject to the following condition to any person obtaining a copy
bsl: use the licensed work for production (?:use )?purposes is not granted
sspl: offering the program as a service requires you to make the service source code available
commons-clause: grant of rights under the license will not include and the license does not grant to you the right to sell
elastic: may not provide the software to third parties as a hosted or managed service
polyform: noncommercial purpose is a permitted purpose
json: software shall be used for good not evil
tcl: authors hereby grant permission to use copy modify distribute and license this software and its documentation
sleepycat: redistributions in any form must be accompanied by information on how to obtain complete source code
vim: distribute a modified vim
imagemagick: imagemagick studio llc
ijg: work of the independent jpeg group
freetype: portions of this software are copyright (?:c )?(?:19|20)[0-9]{2} the freetype project
intel: intel open source license
nist: software was developed at the national institute of standards and technology by employees of the federal government
us-government: work of the united states government(?: and)? is not subject to copyright
llvm: llvm exceptions to the apache 2 0 license
"""

#: Statements that a work is under a license.
GRANTS = """
mit: licensed under (?:the )?(?:terms of the )?mit(?: expat| x11)? licen[cs]e
mit: released under (?:the )?(?:terms of the )?mit(?: expat| x11)? licen[cs]e
mit: distributed under (?:the )?(?:terms of the )?mit(?: expat| x11)? licen[cs]e
mit: available under (?:the )?(?:terms of the )?mit(?: expat| x11)? licen[cs]e
mit: mit licen[cs]e see (?:the )?licen[cs]e(?: file)?
apache-2: licensed under (?:the )?apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?
apache-2: released under (?:the )?apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?
apache-2: distributed under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?
apache-2: available under (?:the )?apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?
apache-2: dual licensed under (?:the )?apache 2(?: 0)? (?:and|or) mit
apache-2: licensed under either of (?:the )?apache licen[cs]e version 2 0
mit: dual licensed under (?:the )?mit (?:and|or) (?:the )?(?:gpl|apache|bsd)
gpl: dual licensed under (?:the )?(?:mit|bsd) (?:and|or) (?:the )?gpl
gpl-2: licensed under (?:the )?(?:gnu )?gpl(?: version)? (?:v)?2
gpl-3: licensed under (?:the )?(?:gnu )?gpl(?: version)? (?:v)?3
gpl-2: licensed under (?:the )?gnu general public licen[cs]e(?: version)? (?:v)?2
gpl-3: licensed under (?:the )?gnu general public licen[cs]e(?: version)? (?:v)?3
gpl-2: released under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version)? (?:v)?2
gpl-3: released under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version)? (?:v)?3
gpl-2: distributed under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version)? (?:v)?2
gpl-3: distributed under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version)? (?:v)?3
gpl: covered by the gnu general public licen[cs]e
lgpl: licensed under (?:the )?(?:gnu )?lgpl
lgpl: released under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e
agpl-3: licensed under (?:the )?(?:gnu )?agpl(?: v)? ?3
agpl-3: released under (?:the )?(?:terms of the )?gnu affero general public licen[cs]e
bsd: governed by a bsd style licen[cs]e
bsd-2: licensed under (?:the )?(?:simplified bsd|bsd 2 clause) licen[cs]e
bsd-3: licensed under (?:the )?(?:new bsd|modified bsd|bsd 3 clause) licen[cs]e
bsd-2: released under (?:the )?(?:simplified bsd|bsd 2 clause) licen[cs]e
bsd-3: released under (?:the )?(?:new bsd|modified bsd|bsd 3 clause) licen[cs]e
mpl-2: licensed under (?:the )?mozilla public licen[cs]e(?: version)?(?: v)? 2
mpl-1-1: licensed under (?:the )?mozilla public licen[cs]e(?: version)? 1 1
epl-1: licensed under (?:the )?eclipse public licen[cs]e(?: version)? (?:v)?1
epl-2: licensed under (?:the )?eclipse public licen[cs]e(?: version)? (?:v)?2
cddl-1: licensed under (?:the )?common development and distribution licen[cs]e
isc: licensed under (?:the )?isc licen[cs]e
zlib: licensed under (?:the )?zlib(?: libpng)? licen[cs]e
boost-1: distributed under the boost software licen[cs]e version 1 0
artistic-2: licensed under (?:the )?artistic licen[cs]e(?: version)? 2
unlicense: released under (?:the )?unlicense
wtfpl: licensed under (?:the )?wtfpl
cc0: released under (?:the )?cc0
public-domain: released (?:in|into|to) the public domain
public-domain: placed (?:in|into) the public domain
public-domain: dedicated to the public domain
public-domain: hereby placed in the public domain
cc-by: licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international)? licen[cs]e
cc-by-sa: licensed under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)? licen[cs]e
cc-by-nc: licensed under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)? licen[cs]e
cc-by-nd: licensed under (?:a |the )?creative commons attribution no ?derivatives(?: [1-4] [05])?(?: international)? licen[cs]e
cc-by-nc-sa: licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)? licen[cs]e
cc-by-nc-nd: licensed under (?:a |the )?creative commons attribution non ?commercial no ?derivatives(?: [1-4] [05])?(?: international)? licen[cs]e
cc-by-sa: available under the creative commons attribution share ?alike licen[cs]e
gfdl: licensed under (?:the )?gnu free documentation licen[cs]e
odbl: licensed under (?:the )?open (?:data commons open )?database licen[cs]e
ofl: licensed under (?:the )?(?:sil )?open font licen[cs]e
perl: licensed under the same terms as perl
php-3: subject to version 3 0(?:1)? of the php licen[cs]e
ruby: distributed under the ruby licen[cs]e
python-2: licensed under (?:the )?(?:python software foundation|psf) licen[cs]e
postgresql: released under the postgresql licen[cs]e
eupl: licensed under the european union public licen[cs]e
ms-pl: licensed under the microsoft public licen[cs]e
ms-rl: licensed under the microsoft reciprocal licen[cs]e
sspl: licensed under the server side public licen[cs]e
elastic: licensed under the elastic licen[cs]e
bsl: licensed under the business source licen[cs]e
commons-clause: commons clause licen[cs]e condition
proprietary: proprietary and confidential
proprietary: unauthorized copying of this file via any medium is strictly prohibited
proprietary: unlicensed copying or redistribution is prohibited
proprietary: may not be reproduced (?:or )?distributed or transmitted in any form or by any means
proprietary: commercial licen[cs]e (?:agreement|required)
proprietary: end user licen[cs]e agreement
proprietary: trade secrets and confidential information
proprietary: subject to the terms of the licen[cs]e agreement
proprietary: for personal non ?commercial use only
proprietary: for evaluation purposes only
"""

#: Identifiers, package metadata and addresses of license texts.
TAGS = """
mit: spdx licen[cs]e identifier mit
mit-0: spdx licen[cs]e identifier mit 0
apache-2: spdx licen[cs]e identifier apache 2 0
apache-1-1: spdx licen[cs]e identifier apache 1 1
llvm: spdx licen[cs]e identifier apache 2 0 with llvm exception
gpl-2: spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-3: spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gpl-1: spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
linux-syscall: spdx licen[cs]e identifier gpl 2 0(?: only| or later)? with linux syscall note
classpath-exception: spdx licen[cs]e identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
lgpl-2: spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
lgpl-2-1: spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
lgpl-3: spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
agpl-3: spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
bsd-2: spdx licen[cs]e identifier bsd 2 clause
bsd-3: spdx licen[cs]e identifier bsd 3 clause
bsd-4: spdx licen[cs]e identifier bsd 4 clause
0bsd: spdx licen[cs]e identifier 0bsd
mpl-1-1: spdx licen[cs]e identifier mpl 1 1
mpl-2: spdx licen[cs]e identifier mpl 2 0
epl-1: spdx licen[cs]e identifier epl 1 0
epl-2: spdx licen[cs]e identifier epl 2 0
cddl-1: spdx licen[cs]e identifier cddl 1 [01]
isc: spdx licen[cs]e identifier isc
zlib: spdx licen[cs]e identifier zlib
boost-1: spdx licen[cs]e identifier bsl 1 0
bsl: spdx licen[cs]e identifier busl 1 1
artistic-2: spdx licen[cs]e identifier artistic 2 0
unlicense: spdx licen[cs]e identifier unlicense
wtfpl: spdx licen[cs]e identifier wtfpl
cc0: spdx licen[cs]e identifier cc0 1 0
cc-by: spdx licen[cs]e identifier cc by [1-4] [05]
cc-by-sa: spdx licen[cs]e identifier cc by sa [1-4] [05]
cc-by-nc: spdx licen[cs]e identifier cc by nc [1-4] [05]
cc-by-nc-sa: spdx licen[cs]e identifier cc by nc sa [1-4] [05]
cc-by-nc-nd: spdx licen[cs]e identifier cc by nc nd [1-4] [05]
ofl: spdx licen[cs]e identifier ofl 1 1
odbl: spdx licen[cs]e identifier odbl 1 0
upl: spdx licen[cs]e identifier upl 1 0
eupl: spdx licen[cs]e identifier eupl 1 [12]
sspl: spdx licen[cs]e identifier sspl 1 0
python-2: spdx licen[cs]e identifier (?:psf|python) 2 0
postgresql: spdx licen[cs]e identifier postgresql
ncsa: spdx licen[cs]e identifier ncsa
ms-pl: spdx licen[cs]e identifier ms pl
proprietary: spdx licen[cs]e identifier licenseref proprietary
mit: opensource org licen[cs]es mit
bsd-2: opensource org licen[cs]es bsd 2 clause
bsd-3: opensource org licen[cs]es bsd 3 clause
apache-2: opensource org licen[cs]es apache 2 0
gpl-2: opensource org licen[cs]es gpl 2 0
gpl-3: opensource org licen[cs]es gpl 3 0
isc: opensource org licen[cs]es isc
artistic-2: opensource org licen[cs]es artistic 2 0
apache-2: apache org licen[cs]es licen[cs]e 2 0
apache-1-1: apache org licen[cs]es licen[cs]e 1 1
gpl: gnu org licen[cs]es gpl
gpl-2: gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0
gpl-3: gnu org licen[cs]es gpl 3 0
lgpl: gnu org licen[cs]es lgpl
lgpl-2-1: gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1
agpl-3: gnu org licen[cs]es agpl
gfdl: gnu org (?:licen[cs]es|copyleft) fdl
mpl-2: mozilla org mpl 2 0
mpl-1-1: mozilla org mpl mpl 1 1
epl-1: eclipse org legal epl v10
epl-2: eclipse org legal epl (?:2 0|v20)
boost-1: boost org licen[cs]e 1 0
unlicense: unlicense org
wtfpl: wtfpl net
cc0: creativecommons org publicdomain zero 1 0
public-domain: creativecommons org licen[cs]es publicdomain
cc-by: creativecommons org licen[cs]es by
cc-by-sa: creativecommons org licen[cs]es by sa
cc-by-nd: creativecommons org licen[cs]es by nd
cc-by-nc: creativecommons org licen[cs]es by nc
cc-by-nc-sa: creativecommons org licen[cs]es by nc sa
cc-by-nc-nd: creativecommons org licen[cs]es by nc nd
ofl: scripts sil org ofl
odbl: opendatacommons org licen[cs]es odbl
odc-by: opendatacommons org licen[cs]es by
pddl: opendatacommons org licen[cs]es pddl
commons-clause: commonsclause com
mit: license osi approved mit licen[cs]e
apache-2: license osi approved apache software licen[cs]e
bsd: license osi approved bsd licen[cs]e
gpl-2: license osi approved gnu general public licen[cs]e v2
gpl-3: license osi approved gnu general public licen[cs]e v3
lgpl: license osi approved gnu (?:lesser|library)(?: or lesser)? general public licen[cs]e
agpl-3: license osi approved gnu affero general public licen[cs]e
mpl-2: license osi approved mozilla public licen[cs]e 2 0
isc: license osi approved isc licen[cs]e
python-2: license osi approved python software foundation licen[cs]e
proprietary: license other proprietary licen[cs]e
public-domain: license public domain
"""

#: Names of licenses.
TITLES = """
mit: mit(?: expat| x11)? licen[cs]e
mit-0: mit no attribution
apache-2: apache licen[cs]e(?: version)? 2(?: 0)?
apache-1-1: apache software licen[cs]e(?: version)? 1 1
apache-1: apache (?:software )?licen[cs]e(?: version)? 1 0
gpl-2: gnu general public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?
gpl-3: gnu general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?
gpl-1: gnu general public licen[cs]e(?: version)?(?: v)? ?1(?: 0)?
gpl: gnu general public licen[cs]e
lgpl-2: gnu library general public licen[cs]e(?: version)?(?: 2(?: 0)?)?
lgpl-2-1: gnu lesser general public licen[cs]e(?: version)?(?: v)? ?2 1
lgpl-3: gnu lesser general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?
lgpl: gnu lesser general public licen[cs]e
agpl-3: gnu affero general public licen[cs]e(?: version)?(?: v)? ?(?:3(?: 0)?)?
agpl-1: affero general public licen[cs]e version 1
gfdl: gnu free documentation licen[cs]e(?: version)?(?: 1 [123])?
gpl: gplv2 or later
gpl-2: gplv2
gpl-3: gplv3
lgpl-2-1: lgplv2 1
lgpl-3: lgplv3
agpl-3: agplv3
bsd-2: bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-3: bsd 3 clause(?: new| revised)?(?: licen[cs]e)?
bsd-4: bsd 4 clause(?: original)?(?: licen[cs]e)?
bsd-2: simplified bsd licen[cs]e
bsd-2: freebsd licen[cs]e
bsd-3: modified bsd licen[cs]e
bsd-3: revised bsd licen[cs]e
bsd-4: original bsd licen[cs]e
bsd: bsd style licen[cs]e
bsd: bsd licen[cs]e
0bsd: zero clause bsd
mpl-1: mozilla public licen[cs]e(?: version)? 1 0
mpl-1-1: mozilla public licen[cs]e(?: version)? 1 1
mpl-2: mozilla public licen[cs]e(?: version)?(?: v)? 2(?: 0)?
npl: netscape public licen[cs]e
epl-1: eclipse public licen[cs]e(?: version)?(?: v)? ?1(?: 0)?
epl-2: eclipse public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?
edl-1: eclipse distribution licen[cs]e
cddl-1: common development and distribution licen[cs]e
cpl-1: common public licen[cs]e
ipl-1: ibm public licen[cs]e
isc: isc licen[cs]e
zlib: zlib(?: libpng)? licen[cs]e
libpng: libpng licen[cs]e
boost-1: boost software licen[cs]e
artistic-1: artistic licen[cs]e(?: version)? 1(?: 0)?
artistic-2: artistic licen[cs]e(?: version)? 2(?: 0)?
artistic: artistic licen[cs]e
unlicense: unlicense
wtfpl: wtfpl
cc0: cc0(?: 1 0)?(?: universal)?
cc-by: creative commons attribution(?: [1-4] [05])?(?: international| unported)?
cc-by-sa: creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nd: creative commons attribution no ?deriv(?:ative)?(?:s)?(?: [1-4] [05])?(?: international| unported)?
cc-by-nc: creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:ative)?(?:s)?(?: [1-4] [05])?(?: international)?
cc0: creative commons zero
cc: creative commons licen[cs]e
ofl: sil open font licen[cs]e
odbl: open (?:data commons open )?database licen[cs]e
odc-by: open data commons attribution licen[cs]e
ogl: open government licen[cs]e
pddl: public domain dedication and licen[cs]e
python-2: python software foundation licen[cs]e
php-3: php licen[cs]e
ruby: ruby licen[cs]e
perl: perl artistic licen[cs]e
postgresql: postgresql licen[cs]e
openssl: openssl licen[cs]e
ncsa: university of illinois ncsa open source licen[cs]e
w3c: w3c software notice and licen[cs]e
afl-3: academic free licen[cs]e
osl-3: open software licen[cs]e
eupl: european union public licen[cs]e
cecill: cecill(?: free software)? licen[cs]e
ms-pl: microsoft public licen[cs]e
ms-rl: microsoft reciprocal licen[cs]e
upl: universal permissive licen[cs]e
bsl: business source licen[cs]e
sspl: server side public licen[cs]e
elastic: elastic licen[cs]e(?: 2 0)?
polyform: polyform (?:noncommercial|small business|shield) licen[cs]e
qpl: q public licen[cs]e
sleepycat: sleepycat licen[cs]e
vim: vim licen[cs]e
json: json licen[cs]e
beerware: beerware licen[cs]e
ofl: open font licen[cs]e
apsl-2: apple public source licen[cs]e
hpnd: historical permission notice and disclaimer
mulan: mulan psl v2
openrail: openrail(?: m)? licen[cs]e
llama: llama (?:2|3) community licen[cs]e
"""

#: Words that speak of rights without naming a license.
HINTS = """
public-domain: public domain
all-rights-reserved: all rights reserved
all-rights-reserved: alle rechte vorbehalten
all-rights-reserved: tous droits r[eé]serv[eé]s
all-rights-reserved: todos los derechos reservados
copyright: copyright (?:c )?(?:19|20)[0-9]{2}
copyright: copyrighted material
copyleft: copyleft
open-source: open source licen[cs]e
permissive: permissive licen[cs]e
proprietary: proprietary licen[cs]e
proprietary: proprietary software
no-derivatives: no derivative works
non-commercial: non ?commercial use only
patent: patent licen[cs]e
royalty-free: royalty free licen[cs]e
warranty: provided as is without warranty of any kind
warranty: without any warranty without even the implied warranty of merchantability
liability: in no event shall the (?:author(?:s)?|copyright holder(?:s)?) (?:or copyright holders )?be liable
trademark: trademarks are the property of their respective owners
"""

#: (priority, confidence, lines).
SECTIONS = ((0, 1.0, NOTICES), (1, 0.95, GRANTS), (2, 0.9, TAGS), (3, 0.8, TITLES), (4, 0.6, HINTS))


def signatures() -> list[tuple[str, str, int, float]]:
    """(label, expression, priority, confidence) of each line, in order."""
    out = []
    for priority, sure, lines in SECTIONS:
        for line in lines.strip().splitlines():
            label, rx = line.split(": ", 1)
            out.append((label, rx, priority, sure))
    return out
