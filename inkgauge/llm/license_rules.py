"""Signature rules of the license scan: written by hand, one pattern a rule, over the words of a text.

A rule is (label, keyword, pattern). Words are in lower case with single spaces between them, so
"SPDX-License-Identifier: MIT" reads "spdx license identifier mit". Every match of a pattern
contains its keyword, which starts a word.
"""

from __future__ import annotations

# a name in any text; contexts in licenses.py raise its confidence
NAMES = (
    ("mit", "mit licen", r"mit licen[sc]e"),
    ("mit", "mit x11", r"mit x11(?: style)? licen[sc]e"),
    ("mit", "expat licen", r"expat licen[sc]e"),
    ("mit", "x11 licen", r"x11 licen[sc]e"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("isc", "isc licen", r"isc licen[sc]e"),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?"),
    ("0bsd", "zero clause bsd", r"zero clause bsd(?: licen[sc]e)?"),
    ("0bsd", "bsd zero clause", r"bsd zero clause(?: licen[sc]e)?"),
    ("bsd-2", "simplified bsd", r"simplified bsd(?: licen[sc]e)?"),
    ("bsd-2", "freebsd", r"freebsd(?: licen[sc]e)?"),
    ("bsd-2", "bsd 2 clause", r"bsd 2 clause(?: bsd)?(?: style)?(?: licen[sc]e)?"),
    ("bsd-2", "2 clause bsd", r"2 clause bsd(?: style)?(?: licen[sc]e)?"),
    ("bsd-2", "two clause bsd", r"two clause bsd(?: style)?(?: licen[sc]e)?"),
    ("bsd-3", "new bsd", r"new bsd(?: licen[sc]e)?"),
    ("bsd-3", "modified bsd", r"modified bsd(?: licen[sc]e)?"),
    ("bsd-3", "revised bsd", r"revised bsd(?: licen[sc]e)?"),
    ("bsd-3", "bsd 3 clause", r"bsd 3 clause(?: bsd)?(?: style)?(?: licen[sc]e)?"),
    ("bsd-3", "3 clause bsd", r"3 clause bsd(?: style)?(?: licen[sc]e)?"),
    ("bsd-3", "three clause bsd", r"three clause bsd(?: style)?(?: licen[sc]e)?"),
    ("bsd-4", "original bsd", r"original bsd(?: licen[sc]e)?"),
    ("bsd-4", "bsd 4 clause", r"bsd 4 clause(?: licen[sc]e)?"),
    ("bsd-4", "4 clause bsd", r"4 clause bsd(?: licen[sc]e)?"),
    ("bsd-4", "four clause bsd", r"four clause bsd(?: licen[sc]e)?"),
    ("bsd", "bsd licen", r"bsd licen[sc]e"),
    ("bsd", "bsd style licen", r"bsd style licen[sc]e"),
    ("apache-1", "apache", r"apache(?: software)? licen[sc]e(?: version| v)? 1(?: [01])?"),
    ("apache-2", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? (?:2|v2)(?: 0)?(?: licen[sc]e)?"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)?2(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)?3(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl-2", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?2(?: [01])?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2", "library general", r"(?:gnu )?library general public licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e(?: (?:version |v)?[23](?: [01])?)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v)?3(?: 0)?)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: version 1(?: [0-3])?)?"),
    ("mpl-1", "mozilla", r"mozilla public licen[sc]e (?:version |v)?1(?: [01])?"),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1", "eclipse", r"eclipse public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("edl-1", "eclipse", r"eclipse distribution licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("cddl", "common development", r"common development and distribution licen[sc]e(?: (?:version )?1(?: [01])?)?"),
    ("cpl", "common public", r"common public licen[sc]e(?: (?:version )?1(?: 0)?)?"),
    ("cpal", "common public attribution", r"common public attribution licen[sc]e(?: (?:version )?1(?: 0)?)?"),
    ("ipl", "ibm public", r"ibm public licen[sc]e(?: (?:version )?1(?: 0)?)?"),
    ("apsl", "apple public", r"apple public source licen[sc]e(?: (?:version )?[12](?: [012])?)?"),
    ("eupl", "european union", r"european union public licen[sc]e(?: (?:version |v)?1(?: [012])?)?"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: licen[sc]e)?"),
    ("osl-3", "open software", r"open software licen[sc]e(?: (?:version |v)?3(?: 0)?)?"),
    ("afl-3", "academic free", r"academic free licen[sc]e(?: (?:version |v)?[23](?: [01])?)?"),
    ("artistic-1", "artistic", r"artistic licen[sc]e(?: 1(?: 0)?)?"),
    ("artistic-2", "artistic", r"artistic licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("boost", "boost software", r"boost software licen[sc]e(?: (?:version )?1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("python", "python", r"python software foundation licen[sc]e(?: (?:version )?2(?: 0)?)?"),
    ("php", "php licen", r"php licen[sc]e(?: (?:version )?3(?: 0 ?1)?)?"),
    ("ruby", "ruby licen", r"ruby licen[sc]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e(?: (?:version )?1(?: [01])?)?"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("ecl-2", "educational community", r"educational community licen[sc]e(?: (?:version )?2(?: 0)?)?"),
    ("mulan-2", "mulan", r"mulan p(?:ermissive software licen[sc]e|sl)(?: (?:version |v)?2)?"),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e(?: 1(?: 0 0)?)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("bsl-1", "business source", r"business source licen[sc]e(?: 1(?: 1)?)?"),
    ("sspl", "server side", r"server side public licen[sc]e(?: (?:version |v)?1)?"),
    ("elastic-2", "elastic licen", r"elastic licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)?(?: condition)?"),
    ("odbl", "open database", r"open database licen[sc]e"),
    ("odc-by", "open data commons attribution", r"open data commons attribution licen[sc]e"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?"),
    ("creative-commons", "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "rights reserved", r"all rights reserved"),
)

# sentences of license texts
BODIES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge(?: to any person obtaining a copy(?: of this software and associated documentation files)?)?"),
    ("mit", "deal in the software", r"deal in the software without restriction(?: including without limitation the rights)?"),
    ("mit", "substantial portions", r"(?:notice and this )?permission notice shall be included in all copies or substantial portions(?: of the software)?"),
    ("mit", "software is provided", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit", "dealings in the software", r"(?:the use or )?other dealings in the software"),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction (?:[a-z]+ ){1,40}permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", "author disclaims", r"the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "software is provided by", r"this software is provided by the (?:[a-z0-9]+ ){1,12}as is and any express or implied warranties"),
    ("bsd-3", "neither the name", r"neither the names? of (?:[a-z0-9]+ ){1,14}may be used to endorse or promote products(?: derived from this software)?"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2", "unless required", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2", "terms and conditions for use", r"terms and conditions for use reproduction and distribution"),
    ("apache-2", "grant of patent", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-1", "products derived", r"products derived from this software may not be called apache"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl", "program is distributed", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-3", "free copyleft", r"the gnu general public license is a free copyleft license for software"),
    ("gpl-2", "licenses for most software", r"the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license"),
    ("gpl-3", "conveying", r"conveying (?:verbatim copies|modified source versions|non source forms)"),
    ("lgpl", "library is free", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "library is distributed", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("agpl-3", "remote network", r"remote network interaction use with the gnu general public license"),
    ("agpl-3", "interacting with it", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant sections", r"with no invariant sections(?: no front cover texts and no back cover texts)?"),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2", "incompatible with secondary", r"incompatible with secondary licenses"),
    ("mpl-1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1"),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-2", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v )?2"),
    ("epl-1", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1"),
    ("epl", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl", "accompanying program", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", "accompanying program", r"the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "for the european union", r"open source licen[sc]e for the european union"),
    ("artistic-2", "package is", r"this package is free software you can redistribute it and or modify it under the terms of the artistic license"),
    ("artistic-1", "semblance of artistic", r"maintains some semblance of artistic control over the development of the package"),
    ("boost", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("openssl", "product includes", r"this product includes software developed by the openssl project"),
    ("apache", "product includes", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("postgresql", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("python", "psf is making", r"psf is making python available to licensee on an as is basis"),
    ("php", "product includes", r"this product includes php software"),
    ("ofl", "font software", r"this font software is licensed under the sil open font license"),
    ("ofl", "reserved font", r"no modified version of the font software may use the reserved font name"),
    ("upl", "larger works", r"larger works to which the software is contributed by such licensors"),
    ("ms-pl", "patent grant", r"patent grant subject to the terms of this license including the license conditions and limitations in section 3 each contributor grants you"),
    ("bsl-1", "additional use grant", r"additional use grant"),
    ("bsl-1", "change license", r"on the change date (?:[a-z0-9]+ ){0,20}the change license"),
    ("sspl", "offering the program", r"offering the program as a service"),
    ("elastic-2", "hosted or managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "right to sell", r"does not grant to you the right to sell the software"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the", r"do what the f(?:uck|\w+)? you want to public licen[sc]e"),
    ("wtfpl", "you just do", r"you just do what the f\w* you want to"),
    ("cc0", "waives", r"waives all (?:of )?(?:his or her|its|their) rights to the work(?: worldwide)? under copyright law"),
    ("cc0", "associated a", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "distribute your contributions", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix transform", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("beerware", "beer ware", r"the beer ware licen[sc]e"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("public-domain", "placed", r"placed in(?:to)? the public domain"),
    ("public-domain", "dedicated to the public", r"(?:hereby )?dedicated to the public domain"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|work|document) may be reproduced(?: stored in a retrieval system)? or transmitted"),
    ("proprietary", "without the prior written", r"without the prior written (?:permission|consent) of the (?:publisher|copyright holder|author|owner)"),
    ("proprietary", "end user license", r"end user licen[sc]e agreement"),
    ("non-commercial", "non commercial use only", r"for (?:personal(?: and)? )?non commercial use only"),
    ("research-only", "research purposes only", r"for (?:academic |non commercial )?research purposes only"),
)

# identifiers after "SPDX-License-Identifier:", alone or in an expression with AND, OR, WITH
TAGS = (
    ("mit", "mit"),
    ("mit-0", "mit 0"),
    ("isc", "isc"),
    ("0bsd", "0bsd"),
    ("bsd-1", "bsd 1 clause"),
    ("bsd-2", "bsd 2 clause"),
    ("bsd-2", "bsd 2 clause patent"),
    ("bsd-3", "bsd 3 clause"),
    ("bsd-3", "bsd 3 clause clear"),
    ("bsd-4", "bsd 4 clause"),
    ("apache-1", "apache 1 [01]"),
    ("apache-2", "apache 2 0"),
    ("gpl-1", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-1", "agpl 1 0(?: only| or later)?"),
    ("agpl-3", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "gfdl 1 [1-3](?: only| or later)?"),
    ("mpl-1", "mpl 1 [01]"),
    ("mpl-2", "mpl 2 0(?: no copyleft exception)?"),
    ("epl-1", "epl 1 0"),
    ("epl-2", "epl 2 0"),
    ("cddl", "cddl 1 [01]"),
    ("cpl", "cpl 1 0"),
    ("cpal", "cpal 1 0"),
    ("ipl", "ipl 1 0"),
    ("apsl", "apsl [12] [012]"),
    ("eupl", "eupl 1 [012]"),
    ("cecill", "cecill(?: 1 [01]| 2 [01]| b| c)"),
    ("osl-3", "osl 3 0"),
    ("afl-3", "afl 3 0"),
    ("artistic-1", "artistic 1 0"),
    ("artistic-2", "artistic 2 0"),
    ("boost", "bsl 1 0"),
    ("bsl-1", "busl 1 1"),
    ("sspl", "sspl 1 0"),
    ("elastic-2", "elastic 2 0"),
    ("zlib", "zlib"),
    ("libpng", "libpng(?: 2 0)?"),
    ("openssl", "openssl"),
    ("postgresql", "postgresql"),
    ("python", "psf 2 0"),
    ("python", "python 2 0"),
    ("php", "php 3 01?"),
    ("ruby", "ruby"),
    ("ofl", "ofl 1 [01]"),
    ("upl", "upl 1 0"),
    ("ncsa", "ncsa"),
    ("ecl-2", "ecl 2 0"),
    ("mulan-2", "mulanpsl 2 0"),
    ("blueoak", "blueoak 1 0 0"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("odbl", "odbl 1 0"),
    ("odc-by", "odc by 1 0"),
    ("pddl", "pddl 1 0"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"),
    ("beerware", "beerware"),
    ("json", "json"),
    ("curl", "curl"),
    ("x11", "x11"),
    ("cc0", "cc0 1 0"),
    ("cc-by", "cc by [1-4] [05]"),
    ("cc-by-sa", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"),
)

# addresses of license texts
ADDRESSES = (
    ("mit", "opensource org", r"opensource org licenses? mit"),
    ("mit", "mit license org", r"mit license org"),
    ("isc", "opensource org", r"opensource org licenses? isc"),
    ("bsd-2", "opensource org", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3", "opensource org", r"opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource org", r"opensource org licenses? bsd license"),
    ("apache-2", "opensource org", r"opensource org licenses? apache 2 0"),
    ("apache-2", "apache org", r"apache org licenses license 2 0"),
    ("apache-1", "apache org", r"apache org licenses license 1 [01]"),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl"),
    ("gpl-2", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu org", r"gnu org licenses gpl 3 0"),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: [23] [01])?"),
    ("agpl-3", "gnu org", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl(?: 1 [1-3])?"),
    ("mpl-2", "mozilla org", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1", "mozilla org", r"mozilla org (?:en us )?mpl (?:mpl )?1 [01]"),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10"),
    ("epl-2", "eclipse org", r"eclipse org legal epl (?:2 0|v20)"),
    ("cddl", "opensource org", r"opensource org licenses? cddl(?: 1 0)?"),
    ("boost", "boost org", r"boost org license 1 0(?: txt)?"),
    ("zlib", "zlib net", r"zlib net zlib license"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("artistic-2", "opensource org", r"opensource org licenses? artistic license 2 0"),
    ("python", "docs python org", r"docs python org (?:[0-9] )*license"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "wtfpl net", r"wtfpl net"),
    ("odbl", "opendatacommons org", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl", "opendatacommons org", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("elastic-2", "elastic co", r"elastic co licensing elastic license"),
    ("bsl-1", "mariadb com", r"mariadb com bsl11"),
)

GRANTED = r"(?:licen[sc]ed|released|distributed|published|available|provided|covered|offered|shared)"
# what takes a license back; the interval ends in the first word of the name that it denies
DENIALS = (
    ("not", rf"not (?!only |just |merely |limited )(?:[a-z]+ ){{0,2}}?(?:{GRANTED} )?under (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?\S+"),
    ("never", rf"never (?:been )?(?:{GRANTED} )?under (?:the |an? )?(?:terms of (?:the )?)?\S+"),
    ("no longer", rf"no longer (?:{GRANTED} )?under (?:the |an? )?(?:terms of (?:the )?)?\S+"),
    ("neither", rf"neither (?:{GRANTED} )?under (?:the )?\S+"),
    ("nor", r"nor under (?:the )?\S+"),
    ("rather than", r"rather than (?:under )?(?:the )?\S+"),
    ("instead of", r"instead of (?:under )?(?:the )?\S+"),
    ("other than", r"other than (?:under )?(?:the )?\S+"),
    ("unlike", r"unlike (?:under )?(?:the )?\S+"),
    ("incompatible with", r"(?:is |are )?incompatible with (?:the )?\S+"),
    ("not compatible", r"not compatible with (?:the )?\S+"),
    ("not a", r"not an? \S+"),
    ("not the", r"not the \S+"),
)
