"""Hand-written signatures of license texts, notices and names, over normalised words.

Fixed values: (label, keyword, priority, confidence, regular expression, an example that it matches). The keyword begins a
word of every text that the expression matches.
"""

SIGNATURES = (
    ("gpl", "either version", 1, 0.9, r"either version [123](?: 0)? of the licen[cs]e or at your option any later version", "either version 2 of the license or at your option any later version"),
    ("gpl", "you should have received", 0, 0.95, r"you should have received a copy of the gnu general public licen[cs]e along with this (?:program|software|file|library)", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", "this program is free", 0, 0.97, r"this program is free software.{0,200}?gnu general public licen[cs]e.{0,80}?version 2 of the licen[cs]e", "this program is free software you can redistribute it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "this program is free", 0, 0.97, r"this program is free software.{0,200}?gnu general public licen[cs]e.{0,80}?version 3 of the licen[cs]e", "this program is free software you can redistribute it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3.0", "gnu general public", 0, 0.98, r"gnu general public licen[cs]e version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "gnu general public", 0, 0.98, r"gnu general public licen[cs]e version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-1.0", "gnu general public", 0, 0.98, r"gnu general public licen[cs]e version 1 february 1989", "gnu general public license version 1 february 1989"),
    ("gpl", "the licenses for most software", 0, 0.95, r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", "the licenses for most software are designed to take away your freedom to share and change"),
    ("gpl", "gpl compatible", 2, 0.6, r"gpl compatible licen[cs]e", "gpl compatible license"),
    ("gpl-2.0-classpath", "classpath exception", 0, 0.95, r"(?:gpl|gnu general public licen[cs]e).{0,40}?with (?:the )?classpath exception", "gpl v2 with the classpath exception"),
    ("gpl-2.0", "gpl version 2", 1, 0.9, r"gpl version 2 (?:or|and) (?:any )?later", "gpl version 2 or later"),
    ("gcc-exception", "gcc runtime library exception", 0, 0.95, r"gcc runtime library exception(?: version 3 1)?", "gcc runtime library exception version 3 1"),
    ("lgpl-2.1", "gnu lesser general public", 0, 0.98, r"gnu lesser general public licen[cs]e version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu lesser general public", 0, 0.98, r"gnu lesser general public licen[cs]e version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.0", "gnu library general public", 0, 0.98, r"gnu library general public licen[cs]e version 2 june 1991", "gnu library general public license version 2 june 1991"),
    ("lgpl", "this library is free software", 0, 0.97, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "you should have received", 0, 0.95, r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "gnu affero general public", 0, 0.98, r"gnu affero general public licen[cs]e version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("agpl", "you should have received", 0, 0.95, r"you should have received a copy of the gnu affero general public licen[cs]e", "you should have received a copy of the gnu affero general public license"),
    ("agpl", "remote network interaction", 1, 0.8, r"remote network interaction use with the gnu general public licen[cs]e", "remote network interaction use with the gnu general public license"),
    ("gfdl", "permission is granted to copy", 0, 0.97, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections", 1, 0.85, r"with no invariant sections no front cover texts and no back cover texts", "with no invariant sections no front cover texts and no back cover texts"),
    ("apache-2.0", "you may not use this file", 0, 0.97, r"you may not use this file except in compliance with the licen[cs]e", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", 0, 0.98, r"apache licen[cs]e version 2 0 january 2004", "apache license version 2 0 january 2004"),
    ("apache-2.0", "www apache org", 0, 0.95, r"https? www apache org licen[cs]es licen[cs]e 2 0(?: txt| html)?", "http www apache org licenses license 2 0 txt"),
    ("apache-2.0", "to the apache software foundation", 0, 0.97, r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "unless required by applicable law", 1, 0.85, r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.0", "this product includes software", 1, 0.85, r"this product includes software developed by the apache group for use in the apache http server project", "this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1.1", "this product includes software", 1, 0.85, r"this product includes software developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("mit", "the above copyright notice", 1, 0.85, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "opensource org", 0, 0.95, r"https? (?:www )?opensource org licen[cs]es mit(?: licen[cs]e)?(?: php| html)?", "https opensource org licenses mit"),
    ("mit", "to deal in the software", 1, 0.8, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "mit", 1, 0.85, r"mit licen[cs]ed", "mit licensed"),
    ("mit", "expat", 1, 0.85, r"expat licen[cs]e", "expat license"),
    ("mit-gpl-dual", "dual", 0, 0.9, r"dual licen[cs]ed under (?:the )?mit (?:licen[cs]e )?(?:and|or) (?:the )?gpl", "dual licensed under the mit and gpl"),
    ("mit-apache-dual", "under either of", 0, 0.9, r"licen[cs]ed under either of apache licen[cs]e.{0,80}?or mit licen[cs]e", "licensed under either of apache license version 2 0 or mit license"),
    ("x11", "except as contained in this notice", 0, 0.9, r"except as contained in this notice the names? of (?:the )?.{1,60}? shall not be used in advertising or otherwise to promote", "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote"),
    ("x11", "x11", 1, 0.85, r"x11 licen[cs]e", "x11 license"),
    ("hpnd", "permission to use copy modify", 0, 0.9, r"permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("mit-0", "mit no attribution", 0, 0.95, r"mit no attribution(?: licen[cs]e)?", "mit no attribution license"),
    ("isc", "permission to use copy modify", 0, 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "zero clause bsd", 0, 0.95, r"zero clause bsd(?: licen[cs]e)?", "zero clause bsd license"),
    ("0bsd", "0bsd", 1, 0.9, r"0bsd", "0bsd"),
    ("bsd-2-clause", "redistributions in binary form", 1, 0.85, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions of source code", 1, 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd-4-clause", "all advertising materials", 0, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-3-clause", "may be used to endorse", 1, 0.85, r"may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "use of this source code", 0, 0.9, r"use of this source code is governed by a bsd style licen[cs]e", "use of this source code is governed by a bsd style license"),
    ("bsd", "bsd style", 1, 0.8, r"bsd style licen[cs]e", "bsd style license"),
    ("bsd", "bsd", 1, 0.85, r"bsd licen[cs]ed", "bsd licensed"),
    ("bsd-3-clause-clear", "no express or implied", 0, 0.9, r"no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-lbnl", "lawrence berkeley national", 1, 0.8, r"lawrence berkeley national (?:laboratory|labs) bsd(?: variant)? licen[cs]e", "lawrence berkeley national labs bsd variant license"),
    ("bsd-protection", "bsd protection", 0, 0.95, r"bsd protection licen[cs]e", "bsd protection license"),
    ("bsd-plus-patent", "bsd 2 clause plus patent", 0, 0.95, r"bsd 2 clause plus patent(?: licen[cs]e)?", "bsd 2 clause plus patent license"),
    ("ncsa", "university of illinois", 0, 0.95, r"university of illinois (?:ncsa )?open source licen[cs]e", "university of illinois ncsa open source license"),
    ("mpl-2.0", "this source code form", 0, 0.97, r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file", 0, 0.97, r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla public", 0, 0.95, r"mozilla public licen[cs]e version 1 0", "mozilla public license version 1 0"),
    ("mpl", "if a copy of the mpl", 0, 0.95, r"if a copy of the mpl was not distributed with this file you can obtain one at", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("npl", "netscape public", 0, 0.95, r"netscape public licen[cs]e(?: version 1 [01])?", "netscape public license version 1 1"),
    ("epl-2.0", "this program and the accompanying", 0, 0.97, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("epl-1.0", "this program and the accompanying", 0, 0.97, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0"),
    ("edl", "eclipse distribution", 0, 0.95, r"eclipse distribution licen[cs]e(?: v(?:ersion)? ?1 0)?", "eclipse distribution license v 1 0"),
    ("cpl-1.0", "common public", 0, 0.95, r"common public licen[cs]e(?: version 1 0)?", "common public license version 1 0"),
    ("cpal-1.0", "common public attribution", 0, 0.95, r"common public attribution licen[cs]e(?: version 1 0)?", "common public attribution license version 1 0"),
    ("ipl-1.0", "ibm public", 0, 0.95, r"ibm public licen[cs]e(?: version 1 0)?", "ibm public license version 1 0"),
    ("cddl", "the contents of this file", 0, 0.97, r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cecill", "cecill", 0, 0.95, r"cecill(?: [bc])?(?: v(?:ersion)? ?[12](?: [01])?)?(?: licen[cs]e)?", "cecill b license"),
    ("eupl", "eupl", 0, 0.97, r"licen[cs]ed under the eupl(?: version| v)?(?: 1 [012])?", "licensed under the eupl version 1 2"),
    ("mulan-psl", "mulan", 0, 0.95, r"mulan (?:permissive software licen[cs]e|psl)(?: v(?:ersion)? ?[12])?", "mulan psl v 2"),
    ("osl-3.0", "open software", 0, 0.95, r"open software licen[cs]e(?: version| v)?(?: ?[123] [01])?", "open software license version 3 0"),
    ("afl-3.0", "academic free", 0, 0.95, r"academic free licen[cs]e(?: version| v)?(?: ?[123] [012])?", "academic free license version 3 0"),
    ("ecl-2.0", "educational community", 0, 0.95, r"educational community licen[cs]e(?: version 2 0)?", "educational community license version 2 0"),
    ("rpl-1.5", "reciprocal public", 0, 0.95, r"reciprocal public licen[cs]e(?: (?:version )?1 [15])?", "reciprocal public license 1 5"),
    ("qpl-1.0", "q public", 0, 0.95, r"q public licen[cs]e(?: version 1 0)?", "q public license version 1 0"),
    ("sleepycat", "sleepycat", 0, 0.95, r"sleepycat licen[cs]e", "sleepycat license"),
    ("sissl", "sun industry standards", 0, 0.95, r"sun industry standards source licen[cs]e", "sun industry standards source license"),
    ("spl-1.0", "sun public", 0, 0.95, r"sun public licen[cs]e(?: version 1 0)?", "sun public license version 1 0"),
    ("upl-1.0", "universal permissive", 0, 0.95, r"universal permissive licen[cs]e(?: (?:version |v ?)?1 0)?", "universal permissive license v 1 0"),
    ("ms-pl", "microsoft public", 0, 0.95, r"microsoft public licen[cs]e(?: ms pl)?", "microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal", 0, 0.95, r"microsoft reciprocal licen[cs]e(?: ms rl)?", "microsoft reciprocal license ms rl"),
    ("apsl-2.0", "apple public source", 0, 0.95, r"apple public source licen[cs]e(?: (?:version )?[12] [012])?", "apple public source license 2 0"),
    ("zpl-2.1", "zope public", 0, 0.95, r"zope public licen[cs]e(?: zpl)?(?: version 2 [01])?", "zope public license zpl version 2 1"),
    ("json", "the software shall be used for good", 0, 0.97, r"the software shall be used for good not evil", "the software shall be used for good not evil"),
    ("beerware", "the beer ware", 0, 0.95, r"the beer ?ware licen[cs]e(?: revision 42)?", "the beer ware license revision 42"),
    ("wtfpl", "do what the fuck you want", 0, 0.97, r"do what the fuck you want to public licen[cs]e", "do what the fuck you want to public license"),
    ("unlicense", "anyone is free to copy", 0, 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("boost", "boost software", 0, 0.97, r"boost software licen[cs]e version 1 0 august 17th 2003", "boost software license version 1 0 august 17th 2003"),
    ("boost", "distributed under the boost", 0, 0.95, r"distributed under the boost software licen[cs]e", "distributed under the boost software license"),
    ("zlib", "altered source versions", 0, 0.95, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "the origin of this software", 1, 0.9, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "libpng", 0, 0.95, r"libpng licen[cs]e(?: version 2)?", "libpng license version 2"),
    ("libtiff", "libtiff", 0, 0.95, r"libtiff licen[cs]e", "libtiff license"),
    ("ijg", "independent jpeg group", 1, 0.85, r"this software is based in part on the work of the independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", 0, 0.95, r"freetype (?:project )?licen[cs]e", "freetype project license"),
    ("curl", "curl", 0, 0.95, r"curl licen[cs]e", "curl license"),
    ("bzip2", "bzip2 and libbzip2", 0, 0.95, r"bzip2 and libbzip2 licen[cs]e(?: v(?:ersion)? ?1 0 [56])?", "bzip2 and libbzip2 license v 1 0 6"),
    ("info-zip", "info zip", 0, 0.95, r"info zip licen[cs]e", "info zip license"),
    ("icu", "icu", 0, 0.95, r"icu licen[cs]e(?: icu 1 8 1 and later)?", "icu license icu 1 8 1 and later"),
    ("unicode", "unicode", 0, 0.95, r"unicode licen[cs]e agreement(?: data files and software)?", "unicode license agreement data files and software"),
    ("unicode", "unicode inc", 0, 0.95, r"unicode inc licen[cs]e(?: agreement)?", "unicode inc license agreement"),
    ("w3c", "w3c software", 0, 0.95, r"w3c software (?:notice and |and document )?(?:licen[cs]e|notice)", "w3c software notice and license"),
    ("vim", "vim", 0, 0.95, r"vim licen[cs]e", "vim license"),
    ("ruby", "ruby", 0, 0.95, r"ruby licen[cs]e", "ruby license"),
    ("perl", "the same terms as perl", 0, 0.95, r"(?:under )?the same terms as perl(?: 5)?(?: itself)?", "under the same terms as perl itself"),
    ("artistic", "artistic", 1, 0.9, r"the (?:clarified )?artistic licen[cs]e(?: 2 0)?", "the artistic license 2 0"),
    ("php", "php", 0, 0.95, r"php licen[cs]e(?: (?:version |v ?)?[23] [0-9]+)?", "php license version 3 01"),
    ("python", "psf", 0, 0.95, r"psf licen[cs]e(?: agreement)?", "psf license agreement"),
    ("python", "python", 1, 0.9, r"python licen[cs]e(?: 2 0)?", "python license 2 0"),
    ("cnri-python", "cnri", 1, 0.9, r"cnri (?:open source )?(?:python )?licen[cs]e(?: agreement)?", "cnri open source license agreement"),
    ("tcl", "tcl tk", 0, 0.95, r"tcl tk licen[cs]e", "tcl tk license"),
    ("postgresql", "postgresql database management", 0, 0.9, r"postgresql database management system formerly known as postgres", "postgresql database management system formerly known as postgres"),
    ("openssl", "this product includes software", 0, 0.93, r"this product includes software developed by the openssl project", "this product includes software developed by the openssl project"),
    ("ssleay", "this product includes cryptographic", 0, 0.93, r"this product includes cryptographic software written by eric young", "this product includes cryptographic software written by eric young"),
    ("lppl", "latex project public", 0, 0.95, r"latex project public licen[cs]e(?: (?:version )?1 [0123]c?)?", "latex project public license version 1 3c"),
    ("ofl", "this font software is", 0, 0.97, r"this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1", "this font software is licensed under the sil open font license version 1 1"),
    ("bitstream-vera", "bitstream vera", 1, 0.85, r"bitstream vera (?:fonts? )?(?:copyright|licen[cs]e)", "bitstream vera fonts copyright"),
    ("ubuntu-font", "ubuntu font licence", 0, 0.95, r"ubuntu font licence(?: version)?(?: 1 0)?", "ubuntu font licence version 1 0"),
    ("intel-osl", "intel open source", 0, 0.95, r"intel open source licen[cs]e", "intel open source license"),
    ("nvidia", "nvidia", 1, 0.85, r"nvidia (?:software|source code|proprietary|open model) licen[cs]e(?: agreement)?", "nvidia source code license"),
    ("oracle-bcl", "oracle binary code", 0, 0.95, r"oracle binary code licen[cs]e agreement", "oracle binary code license agreement"),
    ("oracle-otn", "oracle technology network", 0, 0.95, r"oracle technology network (?:development )?licen[cs]e(?: agreement)?", "oracle technology network license agreement"),
    ("busl-1.1", "business source", 0, 0.95, r"business source licen[cs]e(?: (?:version )?1 1)?", "business source license 1 1"),
    ("sspl-1.0", "server side public", 0, 0.95, r"server side public licen[cs]e(?: (?:version |v ?)?1)?", "server side public license version 1"),
    ("elastic-2.0", "elastic", 0, 0.95, r"elastic licen[cs]e(?: (?:version )?2 0)?", "elastic license 2 0"),
    ("commons-clause", "commons clause", 0, 0.95, r"commons clause (?:licen[cs]e )?condition(?: v(?:ersion)? ?1 0)?", "commons clause license condition v 1 0"),
    ("confluent-community", "confluent community", 0, 0.95, r"confluent community licen[cs]e(?: agreement)?", "confluent community license agreement"),
    ("redis-rsal", "redis source available", 0, 0.95, r"redis source available licen[cs]e(?: 2 0)?", "redis source available license 2 0"),
    ("timescale", "timescale", 0, 0.95, r"timescale licen[cs]e(?: agreement)?", "timescale license agreement"),
    ("polyform", "polyform", 0, 0.95, r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[cs]e(?: 1 0 [01])?", "polyform noncommercial license 1 0 0"),
    ("prosperity", "prosperity public", 0, 0.95, r"prosperity public licen[cs]e(?: [23] 0(?: 0)?)?", "prosperity public license 3 0"),
    ("parity", "parity public", 0, 0.95, r"parity public licen[cs]e(?: [67] 0(?: 0)?)?", "parity public license 7 0"),
    ("blueoak-1.0.0", "blue oak model", 0, 0.95, r"blue oak model licen[cs]e(?: 1 0 0)?", "blue oak model license 1 0 0"),
    ("hippocratic", "hippocratic", 0, 0.95, r"hippocratic licen[cs]e(?: (?:version )?[123] [01])?", "hippocratic license version 2 1"),
    ("llama-community", "llama", 1, 0.85, r"llama(?: [234](?: [0-9])?)? community licen[cs]e agreement", "llama 3 community license agreement"),
    ("gemma", "gemma terms of use", 0, 0.95, r"gemma terms of use", "gemma terms of use"),
    ("openrail", "openrail", 0, 0.95, r"(?:creativeml |bigcode |bigscience )?openrail(?: [ms])?(?: licen[cs]e)?", "creativeml openrail m license"),
    ("cdla-permissive", "community data", 0, 0.95, r"community data licen[cs]e agreement permissive(?: (?:version )?[12] 0)?", "community data license agreement permissive version 2 0"),
    ("cdla-sharing", "community data", 0, 0.95, r"community data licen[cs]e agreement sharing(?: (?:version )?1 0)?", "community data license agreement sharing version 1 0"),
    ("odc-by", "open data commons attribution", 0, 0.95, r"open data commons attribution licen[cs]e(?: v(?:ersion)? ?1 0)?", "open data commons attribution license v 1 0"),
    ("pddl", "public domain dedication", 0, 0.95, r"public domain dedication and licen[cs]e(?: pddl)?", "public domain dedication and license pddl"),
    ("odbl", "the open database", 1, 0.9, r"made available under the open database licen[cs]e", "made available under the open database license"),
    ("ogl-uk", "open government licence", 0, 0.95, r"open government licence(?: v(?:ersion)? ?[123] 0)?", "open government licence v 3 0"),
    ("etalab", "licence ouverte", 0, 0.95, r"licence ouverte(?: (?:version )?[12] 0)?", "licence ouverte version 2 0"),
    ("dl-de-by", "datenlizenz deutschland", 0, 0.95, r"datenlizenz deutschland namensnennung(?: version 2 0)?", "datenlizenz deutschland namensnennung version 2 0"),
    ("cc0", "creative commons zero", 0, 0.95, r"creative commons zero(?: v ?1 0)?(?: universal)?(?: licen[cs]e)?", "creative commons zero v1 0 universal license"),
    ("cc0", "to the extent possible under law", 0, 0.95, r"to the extent possible under law .{1,80}? (?:has|have) waived all copyright and related or neighbou?ring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("cc-by", "http creativecommons org", 0, 0.97, r"http creativecommons org licen[cs]es by [1234] [05]", "http creativecommons org licenses by 4 0"),
    ("cc-by", "https creativecommons org", 0, 0.97, r"https creativecommons org licen[cs]es by [1234] [05]", "https creativecommons org licenses by 4 0"),
    ("cc-by-sa", "https creativecommons org", 0, 0.97, r"https creativecommons org licen[cs]es by sa [1234] [05]", "https creativecommons org licenses by sa 4 0"),
    ("cc-by-nc", "https creativecommons org", 0, 0.97, r"https creativecommons org licen[cs]es by nc [1234] [05]", "https creativecommons org licenses by nc 4 0"),
    ("cc-by-nd", "https creativecommons org", 0, 0.97, r"https creativecommons org licen[cs]es by nd [1234] [05]", "https creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa", "https creativecommons org", 0, 0.97, r"https creativecommons org licen[cs]es by nc sa [1234] [05]", "https creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd", "https creativecommons org", 0, 0.97, r"https creativecommons org licen[cs]es by nc nd [1234] [05]", "https creativecommons org licenses by nc nd 4 0"),
    ("cc0", "https creativecommons org publicdomain", 0, 0.97, r"https creativecommons org publicdomain zero 1 0", "https creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial", 0, 0.95, r"creative commons attribution noncommercial share ?alike(?: [1234] [05])?(?: international)?", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial", 0, 0.95, r"creative commons attribution noncommercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international)?", "creative commons attribution noncommercial noderivs 4 0"),
    ("cc-by-nd", "creative commons attribution no", 0, 0.95, r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international)?", "creative commons attribution noderivatives 4 0 international"),
    ("cc", "some rights reserved", 2, 0.6, r"some rights reserved", "some rights reserved"),
    ("ukn-public-domain", "no copyright is claimed", 1, 0.85, r"no copyright is claimed in the united states under title 17", "no copyright is claimed in the united states under title 17"),
    ("public-domain", "no rights reserved", 1, 0.85, r"no rights reserved", "no rights reserved"),
    ("public-domain", "this work is in the public", 1, 0.9, r"this work is in the public domain", "this work is in the public domain"),
    ("public-domain", "us government work", 1, 0.85, r"us government work not subject to copyright", "us government work not subject to copyright"),
    ("proprietary", "may not be reproduced", 1, 0.8, r"may not be reproduced (?:in any form |or transmitted )?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", "may not be reproduced without the prior written permission"),
    ("proprietary", "copying of this file", 1, 0.85, r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "no part of this", 1, 0.8, r"no part of this (?:publication|book|document|work|site) may be (?:reproduced|copied|distributed|transmitted)", "no part of this publication may be reproduced"),
    ("proprietary", "this software is the proprietary", 1, 0.85, r"this software is the (?:confidential and )?proprietary (?:information|property) of", "this software is the proprietary information of"),
    ("proprietary", "all content on this site", 1, 0.75, r"all content on this (?:site|website) is (?:protected by )?copyright(?:ed)?", "all content on this site is protected by copyright"),
    ("proprietary", "trade secret", 2, 0.6, r"trade secrets? (?:and|or) confidential information", "trade secrets and confidential information"),
    ("eula", "end user", 0, 0.9, r"end user licen[cs]e agreement(?: eula)?", "end user license agreement eula"),
    ("eula", "by installing", 1, 0.8, r"by installing (?:copying )?or (?:otherwise )?using (?:this|the) software you agree to be bound by", "by installing or using this software you agree to be bound by"),
    ("non-commercial", "for non", 1, 0.8, r"for non ?commercial use only", "for non commercial use only"),
    ("non-commercial", "for personal and", 1, 0.75, r"for personal and non ?commercial (?:use|purposes) only", "for personal and non commercial use only"),
    ("non-commercial", "for research purposes only", 1, 0.75, r"for research purposes only", "for research purposes only"),
    ("no-training", "may not be used to train", 0, 0.9, r"may not be used to train (?:any )?(?:machine learning|artificial intelligence|ai|language) (?:models?|systems?)", "may not be used to train any machine learning models"),
)
