"""The signature rules of license_scan, in their order: (label, priority 1 to 5, weight, keyword, expression).

Expressions are over words of lower-case texts with single spaces between them. Whatever an expression matches contains its keyword.
Priorities: 5 identifiers, 4 passages of the license texts, 3 statements that put a work under a license, 2 full names and addresses, 1 mentions.
"""

RULES = (
    # MIT and its relatives
    ("mit", 5, 1.0, "spdx license identifier mit", r"spdx license identifier mit(?: 0)?"),
    ("mit", 4, 1.0, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 4, 1.0, "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", 4, 0.9, "deal in the software", r"to deal in the software without restriction"),
    ("mit", 4, 0.8, "in no event shall the authors", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 3, 0.95, "mit licen", r"(?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?mit licen[sc]e"),
    ("mit", 3, 0.9, "mit licen", r"(?:covered|governed) by the (?:terms of the )?mit licen[sc]e"),
    ("mit", 2, 0.9, "opensource org", r"opensource org licenses? mit(?: license(?: php)?)?"),
    ("mit", 2, 0.85, "expat licen", r"(?:the )?expat licen[sc]e"),
    ("mit", 1, 0.75, "mit licen", r"(?:the )?mit licen[sc]ed?"),
    ("mit", 1, 0.7, "licen", r"licen[sc]e (?:is )?mit"),
    ("x11", 2, 0.85, "x11 licen", r"(?:the )?(?:mit )?x11 licen[sc]e"),
    ("x11", 4, 0.9, "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-0", 2, 0.9, "mit no attribution", r"mit no attribution(?: licen[sc]e)?"),
    # Apache
    ("apache", 5, 1.0, "spdx license identifier apache", r"spdx license identifier apache [12](?: [01])?"),
    ("apache", 4, 1.0, "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", 4, 0.95, "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache", 4, 0.95, "apache license", r"apache license version 2 0 january 2004"),
    ("apache", 4, 0.9, "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", 4, 0.85, "perpetual worldwide non exclusive", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[sc]e"),
    ("apache", 3, 0.95, "apache", r"(?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?apache(?: software)? licen[sc]e"),
    ("apache", 3, 0.9, "apache", r"(?:covered|governed) by the (?:terms of the )?apache licen[sc]e"),
    ("apache", 2, 0.95, "apache org licenses", r"(?:www )?apache org licenses(?: license [12](?: [01])?)?"),
    ("apache", 2, 0.9, "apache licen", r"(?:the )?apache licen[sc]e (?:version |v)?[12](?: [01])?"),
    ("apache", 1, 0.75, "apache", r"(?:the )?apache(?: software)? licen[sc]e"),
    ("apache", 1, 0.7, " asl 2", r"asl 2 0"),
    ("apache", 1, 0.7, "licen", r"licen[sc]e (?:is )?apache(?: 2(?: 0)?)?"),
    # GNU GPL
    ("gpl", 5, 1.0, "spdx license identifier gpl", r"spdx license identifier gpl [123] 0(?: only| or later)?"),
    ("gpl", 4, 1.0, "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 4, 0.9, "gnu general public license for more details", r"see the gnu general public license for more details"),
    ("gpl", 4, 0.9, "along with this program", r"you should have received a copy of the gnu general public license along with this (?:program|software|library)"),
    ("gpl", 4, 0.9, "guarantee your freedom", r"general public license is intended to guarantee your freedom to share and change"),
    ("gpl", 4, 0.85, "preamble the licenses for most software", r"preamble the licenses for most software are designed to take away your freedom"),
    ("gpl", 3, 0.95, " gpl", r"(?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?(?:gnu )?gpl"),
    ("gpl", 3, 0.95, "general public licen", r"(?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?(?:gnu )?general public licen[sc]e"),
    ("gpl", 3, 0.9, " gpl", r"(?:covered|governed) by the (?:gnu )?gpl(?:v?[23])?"),
    ("gpl", 3, 0.8, "free software foundation", r"as published by the free software foundation"),
    ("gpl", 2, 0.95, "gnu org licenses gpl", r"(?:www )?gnu org licenses gpl(?: [123] 0)?(?: html| txt)?"),
    ("gpl", 2, 0.9, "general public licen", r"(?:the )?gnu general public licen[sc]e(?: version [123]| v[123])?"),
    ("gpl", 2, 0.9, " gplv", r"gplv[123](?: only| or later)?"),
    ("gpl", 2, 0.85, " gpl", r"gpl (?:version |v)[123](?: 0)?(?: only| or later)?"),
    ("gpl", 1, 0.75, " gpl", r"(?:the )?(?:gnu )?gpl(?: licen[sc]ed?)?"),
    ("gpl", 2, 0.8, "classpath exception", r"(?:with )?(?:the )?classpath exception"),
    ("gpl", 2, 0.8, "gcc runtime library exception", r"gcc runtime library exception"),
    # GNU LGPL
    ("lgpl", 5, 1.0, "spdx license identifier lgpl", r"spdx license identifier lgpl [23] [01](?: only| or later)?"),
    ("lgpl", 4, 1.0, "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", 4, 0.9, "general public license for more details", r"see the gnu (?:lesser|library) general public license for more details"),
    ("lgpl", 3, 0.95, " lgpl", r"(?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?(?:gnu )?lgpl"),
    ("lgpl", 3, 0.95, "lesser general public licen", r"(?:licensed|released|distributed|published|available|provided) under the (?:terms of the )?(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", 2, 0.95, "gnu org licenses lgpl", r"(?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("lgpl", 2, 0.9, "lesser general public licen", r"(?:the )?(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", 2, 0.9, "library general public licen", r"(?:the )?(?:gnu )?library general public licen[sc]e"),
    ("lgpl", 2, 0.85, " lgpl", r"lgpl ?v?[23](?: [01])?"),
    ("lgpl", 1, 0.75, " lgpl", r"(?:the )?(?:gnu )?lgpl"),
    # GNU AGPL and FDL
    ("agpl", 5, 1.0, "spdx license identifier agpl", r"spdx license identifier agpl [13] 0(?: only| or later)?"),
    ("agpl", 4, 1.0, "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", 4, 0.9, "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("agpl", 3, 0.95, " agpl", r"(?:licensed|released|distributed|available) under the (?:terms of the )?(?:gnu )?agpl"),
    ("agpl", 3, 0.95, "affero general public licen", r"(?:licensed|released|distributed|available) under the (?:terms of the )?(?:gnu )?affero general public licen[sc]e"),
    ("agpl", 2, 0.95, "gnu org licenses agpl", r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("agpl", 2, 0.9, "affero general public licen", r"(?:the )?(?:gnu )?affero general public licen[sc]e"),
    ("agpl", 1, 0.75, " agpl", r"(?:the )?(?:gnu )?agpl(?: ?v?3)?"),
    ("gfdl", 5, 1.0, "spdx license identifier gfdl", r"spdx license identifier gfdl 1 [123](?: only| or later)?"),
    ("gfdl", 4, 1.0, "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 2, 0.9, "free documentation licen", r"(?:the )?(?:gnu )?free documentation licen[sc]e"),
    ("gfdl", 1, 0.7, " gfdl", r"(?:the )?(?:gnu )?gfdl"),
    # BSD
    ("bsd", 5, 1.0, "spdx license identifier bsd", r"spdx license identifier bsd [1234] clause"),
    ("bsd", 5, 1.0, "spdx license identifier 0bsd", r"spdx license identifier 0bsd"),
    ("bsd", 4, 1.0, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 4, 0.95, "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 4, 0.95, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 4, 0.95, "endorse or promote", r"(?:may|must not) be used to endorse or promote products derived from this software"),
    ("bsd", 4, 0.95, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment"),
    ("bsd", 4, 0.8, "regents and contributors", r"this software is provided by the regents and contributors as is"),
    ("bsd", 4, 0.8, "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", 3, 0.95, " bsd", r"(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of the )?(?:[0234] clause |new |modified |simplified )?bsd(?: style)? licen[sc]e"),
    ("bsd", 2, 0.9, "clause bsd", r"(?:the )?[01234] clause bsd(?: licen[sc]e)?"),
    ("bsd", 2, 0.9, " bsd", r"bsd [01234] clause(?: licen[sc]e)?"),
    ("bsd", 2, 0.85, "bsd licen", r"(?:the )?(?:new|modified|simplified|revised|original) bsd licen[sc]e"),
    ("bsd", 1, 0.75, " bsd", r"(?:the |a )?bsd(?: style| like)? licen[sc]ed?"),
    ("bsd", 2, 0.8, "freebsd licen", r"(?:the )?freebsd licen[sc]e"),
    # ISC
    ("isc", 5, 1.0, "spdx license identifier isc", r"spdx license identifier isc"),
    ("isc", 4, 1.0, "permission to use copy modify and", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("isc", 4, 0.8, "disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("isc", 3, 0.95, "isc licen", r"(?:licensed|released|distributed|available) under the (?:terms of the )?isc licen[sc]e"),
    ("isc", 1, 0.75, "isc licen", r"(?:the )?isc licen[sc]ed?"),
    ("isc", 1, 0.7, "licen", r"licen[sc]e (?:is )?isc"),
    # Mozilla, Eclipse, CDDL, CPL and other file-level copyleft
    ("mpl", 5, 1.0, "spdx license identifier mpl", r"spdx license identifier mpl [12] [01]"),
    ("mpl", 4, 1.0, "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", 4, 0.9, "copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", 4, 0.9, "subject to the mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("mpl", 3, 0.95, " mpl", r"(?:licensed|released|distributed|available) under the (?:terms of the )?mpl"),
    ("mpl", 3, 0.95, "mozilla public licen", r"(?:licensed|released|distributed|available) under the (?:terms of the )?mozilla public licen[sc]e"),
    ("mpl", 2, 0.95, "mozilla org mpl", r"(?:www )?mozilla org mpl(?: [12] [01])?"),
    ("mpl", 2, 0.9, "mozilla public licen", r"(?:the )?mozilla public licen[sc]e(?: version| v)?(?: [12](?: [01])?)?"),
    ("mpl", 1, 0.7, " mpl", r"mpl ?(?:v )?[12](?: [01])?"),
    ("epl", 5, 1.0, "spdx license identifier epl", r"spdx license identifier epl [12] 0"),
    ("epl", 4, 1.0, "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl", 2, 0.95, "eclipse org legal", r"(?:www )?eclipse org legal epl(?: v?[12]0?)?(?: html)?"),
    ("epl", 2, 0.9, "eclipse public licen", r"(?:the )?eclipse public licen[sc]e(?: version| v)?(?: [12](?: 0)?)?"),
    ("epl", 1, 0.7, " epl", r"epl ?(?:v )?[12](?: 0)?"),
    ("cddl", 5, 1.0, "spdx license identifier cddl", r"spdx license identifier cddl 1 [01]"),
    ("cddl", 4, 0.95, "common development and distribution", r"subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl", 2, 0.9, "common development and distribution", r"(?:the )?common development and distribution licen[sc]e"),
    ("cddl", 1, 0.75, "cddl", r"(?:the )?cddl(?: (?:v )?1 [01])?"),
    ("cpl", 5, 1.0, "spdx license identifier cpl", r"spdx license identifier cpl 1 0"),
    ("cpl", 2, 0.85, "common public licen", r"(?:the )?(?:ibm )?common public licen[sc]e"),
    ("ipl", 2, 0.85, "ibm public licen", r"(?:the )?ibm public licen[sc]e"),
    ("npl", 2, 0.85, "netscape public licen", r"(?:the )?netscape public licen[sc]e"),
    ("apsl", 2, 0.9, "apple public source licen", r"(?:the )?apple public source licen[sc]e"),
    ("sissl", 2, 0.85, "sun industry standards source licen", r"(?:the )?sun industry standards source licen[sc]e"),
    ("osl", 5, 1.0, "spdx license identifier osl", r"spdx license identifier osl [123] [01]"),
    ("osl", 2, 0.9, "open software licen", r"(?:the )?open software licen[sc]e (?:version |v )?[123](?: [01])?"),
    ("afl", 2, 0.9, "academic free licen", r"(?:the )?academic free licen[sc]e(?: (?:version |v )?[123](?: [01])?)?"),
    ("eupl", 5, 1.0, "spdx license identifier eupl", r"spdx license identifier eupl 1 [012]"),
    ("eupl", 2, 0.9, "european union public licen", r"(?:the )?european union public licen[sc]e"),
    ("eupl", 1, 0.75, " eupl", r"(?:the )?eupl(?: (?:v )?1 [012])?"),
    ("cecill", 2, 0.9, "cecill", r"(?:the )?cecill(?: [bc])?(?: licen[sc]e)?"),
    ("qpl", 2, 0.85, "q public licen", r"(?:the )?q public licen[sc]e"),
    # Permissive, smaller
    ("zlib", 5, 1.0, "spdx license identifier zlib", r"spdx license identifier zlib"),
    ("zlib", 4, 0.9, "as is without any express", r"this software is provided as is without any express or implied warranty"),
    ("zlib", 4, 1.0, "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 4, 0.95, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", 1, 0.75, "zlib", r"(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("libpng", 1, 0.75, "libpng licen", r"(?:the )?libpng licen[sc]e"),
    ("boost", 5, 1.0, "spdx license identifier bsl 1", r"spdx license identifier bsl 1 0"),
    ("boost", 4, 1.0, "machine executable object code", r"in the form of machine executable object code generated by a source language processor"),
    ("boost", 3, 0.95, "boost software licen", r"distributed under the boost software licen[sc]e"),
    ("boost", 2, 0.9, "boost org license", r"(?:www )?boost org license 1 0 txt"),
    ("boost", 2, 0.85, "boost software licen", r"(?:the )?boost software licen[sc]e"),
    ("artistic", 5, 1.0, "spdx license identifier artistic", r"spdx license identifier artistic [12] 0"),
    ("artistic", 4, 0.9, "artistic control", r"maintains some semblance of artistic control over the development of the package"),
    ("artistic", 3, 0.9, "same terms as perl", r"(?:modify it )?under the same terms as perl(?: itself)?"),
    ("artistic", 2, 0.85, "artistic licen", r"(?:the )?(?:perl )?artistic licen[sc]e(?: [12](?: 0)?)?"),
    ("python", 5, 1.0, "spdx license identifier p", r"spdx license identifier (?:psf 2 0|python 2 0)"),
    ("python", 2, 0.9, "python software foundation licen", r"(?:the )?python software foundation licen[sc]e"),
    ("python", 1, 0.75, "psf licen", r"(?:the )?psf licen[sc]e"),
    ("postgresql", 5, 1.0, "spdx license identifier postgresql", r"spdx license identifier postgresql"),
    ("postgresql", 1, 0.8, "postgresql licen", r"(?:the )?postgresql licen[sc]e"),
    ("openssl", 4, 0.95, "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 1, 0.8, "openssl licen", r"(?:the )?openssl licen[sc]e"),
    ("ssleay", 2, 0.85, "ssleay", r"(?:the )?(?:original )?ssleay licen[sc]e"),
    ("curl", 1, 0.75, "curl licen", r"(?:the )?curl licen[sc]e"),
    ("ncsa", 5, 1.0, "spdx license identifier ncsa", r"spdx license identifier ncsa"),
    ("ncsa", 2, 0.9, "ncsa", r"(?:the )?university of illinois ncsa open source licen[sc]e"),
    ("upl", 5, 1.0, "spdx license identifier upl", r"spdx license identifier upl 1 0"),
    ("upl", 2, 0.9, "universal permissive licen", r"(?:the )?universal permissive licen[sc]e"),
    ("ms-pl", 5, 1.0, "spdx license identifier ms", r"spdx license identifier ms (?:pl|rl)"),
    ("ms-pl", 2, 0.9, "microsoft public licen", r"(?:the )?microsoft public licen[sc]e"),
    ("ms-rl", 2, 0.9, "microsoft reciprocal licen", r"(?:the )?microsoft reciprocal licen[sc]e"),
    ("wtfpl", 5, 1.0, "spdx license identifier wtfpl", r"spdx license identifier wtfpl"),
    ("wtfpl", 2, 0.9, "you want to public licen", r"do what the f[a-z]* you want to public licen[sc]e"),
    ("wtfpl", 1, 0.8, "wtfpl", r"(?:the )?wtfpl"),
    ("beerware", 2, 0.9, "beer ware licen", r"(?:the )?beer ware licen[sc]e"),
    ("beerware", 4, 0.9, "buy me a beer", r"you can buy me a beer in return"),
    ("ruby", 1, 0.75, "ruby licen", r"(?:the )?ruby licen[sc]e"),
    ("php", 2, 0.85, "php licen", r"(?:the )?php licen[sc]e(?: (?:version |v )?[23](?: [0-9]+)?)?"),
    ("zope", 2, 0.85, "zope public licen", r"(?:the )?zope public licen[sc]e"),
    ("vim", 1, 0.75, "vim licen", r"(?:the )?vim licen[sc]e"),
    ("w3c", 2, 0.9, "w3c software", r"(?:the )?w3c software (?:notice and )?(?:document )?licen[sc]e"),
    ("unicode", 2, 0.85, "unicode inc", r"unicode inc licen[sc]e agreement"),
    ("icu", 1, 0.75, "icu licen", r"(?:the )?icu licen[sc]e"),
    ("jasper", 1, 0.75, "jasper licen", r"(?:the )?jasper licen[sc]e"),
    ("json", 4, 0.9, "good not evil", r"the software shall be used for good not evil"),
    ("blueoak", 2, 0.9, "blue oak model licen", r"(?:the )?blue oak model licen[sc]e"),
    ("mulan", 2, 0.9, "mulan", r"(?:the )?mulan (?:psl v[12]|permissive software licen[sc]e)"),
    # Public domain and Creative Commons
    ("unlicense", 5, 1.0, "spdx license identifier unlicense", r"spdx license identifier unlicense"),
    ("unlicense", 4, 1.0, "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, 0.9, "unlicense org", r"(?:www )?unlicense org"),
    ("unlicense", 1, 0.8, "the unlicense", r"the unlicense"),
    ("public-domain", 3, 0.85, "public domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 2, 0.75, "public domain", r"(?:is |are )?in the public domain"),
    ("cc0", 5, 1.0, "spdx license identifier cc0", r"spdx license identifier cc0 1 0"),
    ("cc0", 4, 1.0, "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc0", 4, 0.9, "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0", 2, 0.9, "creative commons zero", r"creative commons zero"),
    ("cc0", 1, 0.8, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", 5, 1.0, "spdx license identifier cc by", r"spdx license identifier cc by [1234] 0"),
    ("cc-by", 4, 1.0, "creativecommons org licenses by", r"creativecommons org licenses by(?= [0-9])"),
    ("cc-by", 2, 0.9, "creative commons attribution", r"(?:the |a )?creative commons attribution(?: [1234] 0)?(?: international| unported| generic)? licen[sc]e"),
    ("cc-by", 1, 0.75, " cc by", r"cc by(?= [1234] )"),
    ("cc-by-sa", 5, 1.0, "spdx license identifier cc by sa", r"spdx license identifier cc by sa [1234] 0"),
    ("cc-by-sa", 4, 1.0, "creativecommons org licenses by sa", r"creativecommons org licenses by sa"),
    ("cc-by-sa", 2, 0.9, "creative commons attribution share", r"(?:the |a )?creative commons attribution share ?alike"),
    ("cc-by-sa", 1, 0.75, " cc by sa", r"cc by sa(?: [1234] 0)?"),
    ("cc-by-nc", 5, 1.0, "spdx license identifier cc by nc", r"spdx license identifier cc by nc(?: sa| nd)? [1234] 0"),
    ("cc-by-nc", 4, 1.0, "creativecommons org licenses by nc", r"creativecommons org licenses by nc(?: sa| nd)?"),
    ("cc-by-nc", 2, 0.9, "creative commons attribution non", r"(?:the |a )?creative commons attribution non ?commercial(?: share ?alike| no ?deriv(?:atives|s)?)?"),
    ("cc-by-nc", 1, 0.75, " cc by nc", r"cc by nc(?: sa| nd)?(?: [1234] 0)?"),
    ("cc-by-nd", 5, 1.0, "spdx license identifier cc by nd", r"spdx license identifier cc by nd [1234] 0"),
    ("cc-by-nd", 4, 1.0, "creativecommons org licenses by nd", r"creativecommons org licenses by nd"),
    ("cc-by-nd", 2, 0.9, "creative commons attribution no", r"(?:the |a )?creative commons attribution no ?deriv(?:atives|s)?"),
    ("cc-by-nd", 1, 0.75, " cc by nd", r"cc by nd(?: [1234] 0)?"),
    ("cc", 1, 0.6, "creative commons licen", r"(?:a |the )?creative commons licen[sc]e"),
    # Data, fonts, models
    ("odbl", 2, 0.9, "open database licen", r"(?:the )?(?:open data commons )?open database licen[sc]e"),
    ("odbl", 1, 0.75, " odbl", r"(?:the )?odbl(?: 1 0)?"),
    ("odc-by", 2, 0.9, "open data commons attribution", r"(?:the )?open data commons attribution licen[sc]e"),
    ("pddl", 2, 0.9, "public domain dedication and licen", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("ogl", 2, 0.9, "open government licen", r"(?:the )?open government licen[sc]e(?: v[123](?: 0)?)?"),
    ("ofl", 5, 1.0, "spdx license identifier ofl", r"spdx license identifier ofl 1 [01](?: rfn| no rfn)?"),
    ("ofl", 4, 0.95, "sil open font licen", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", 2, 0.9, "open font licen", r"(?:the )?(?:sil )?open font licen[sc]e(?: version 1 [01])?"),
    ("ofl", 1, 0.7, " ofl 1", r"ofl 1 [01]"),
    ("openrail", 2, 0.85, "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?"),
    # Source-available and proprietary
    ("sspl", 2, 0.9, "server side public licen", r"(?:the )?server side public licen[sc]e"),
    ("sspl", 1, 0.75, " sspl", r"(?:the )?sspl(?: 1 0)?"),
    ("busl", 2, 0.9, "business source licen", r"(?:the )?business source licen[sc]e"),
    ("elastic", 2, 0.85, "elastic licen", r"(?:the )?elastic licen[sc]e(?: 2 0)?"),
    ("commons-clause", 2, 0.9, "commons clause", r"(?:the )?commons clause(?: licen[sc]e)?"),
    ("polyform", 2, 0.9, "polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[sc]e"),
    ("proprietary", 4, 0.9, "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 3, 0.85, "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", 2, 0.8, "confidential and proprietary", r"confidential and proprietary(?: information)?"),
    ("proprietary", 2, 0.8, "end user licen", r"end user licen[sc]e agreement"),
    ("proprietary", 2, 0.7, "may not be reproduced", r"may not be reproduced (?:or distributed )?without (?:prior |express )?(?:written )?permission"),
    ("proprietary", 1, 0.5, "all rights reserved", r"all rights reserved"),
    ("proprietary", 1, 0.6, "all rights reserved", r"copyright (?:\S+ ){1,6}all rights reserved"),
)
