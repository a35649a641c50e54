"""Signature rules for licence scans: a hand-written table of families and notices."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A regex over normalised words, tried only where ``keyword`` (whole words) occurs.

    ``tier`` orders rules: where one detection lies inside another of the same or
    a lower tier number, it is suppressed.
    """

    label: str
    keyword: str
    pattern: str
    tier: int
    confidence: float


#: label, keyword that any match contains, name as a regex over words, SPDX identifier as words
FAMILIES: list[tuple[str, str, str, str]] = [
    ("gpl-1.0", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", "general public license", "gnu library general public license (?:v|version )2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "general public license", "gnu lesser general public license (?:v|version )2 1", "lgpl 2 1"),
    ("lgpl-3.0", "general public license", "gnu lesser general public license (?:v|version )3(?: 0)?", "lgpl 3 0"),
    ("agpl-3.0", "general public license", "gnu affero general public license(?: (?:v|version )3(?: 0)?)?", "agpl 3 0"),
    ("gfdl", "documentation license", "gnu free documentation license", "gfdl 1 3"),
    ("apache-1.0", "apache", "apache (?:software )?license (?:v|version )1 0", "apache 1 0"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:v|version )1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?license (?:v|version )2(?: 0)?", "apache 2 0"),
    ("mit", "license", "(?:expat|mit x11|mit) license", "mit"),
    ("mit-0", "license", "mit no attribution license", "mit 0"),
    ("bsd-2-clause", "bsd", "(?:2 clause bsd|bsd 2 clause|simplified bsd) license", "bsd 2 clause"),
    ("bsd-2-clause-views", "freebsd", "freebsd (?:copyright|license)", "bsd 2 clause views"),
    ("bsd-3-clause", "bsd", "(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) license", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:4 clause bsd|bsd 4 clause|original bsd) license", "bsd 4 clause"),
    ("bsd", "bsd", "bsd license", "bsd"),
    ("0bsd", "bsd", "(?:zero clause bsd|0 clause bsd|bsd zero clause) license", "0bsd"),
    ("bsd-1-clause", "bsd", "(?:1 clause bsd|bsd 1 clause) license", "bsd 1 clause"),
    ("bsd-2-clause-patent", "bsd", "bsd 2 clause plus patent license", "bsd 2 clause patent"),
    ("bsd-3-clause-clear", "bsd", "(?:clear bsd|bsd 3 clause clear) license", "bsd 3 clause clear"),
    ("apl-1.0", "adaptive public", "adaptive public license(?: version)?(?: 1 0)?", "apl 1 0"),
    ("apsl-2.0", "apple public", "apple public source license(?: (?:v|version )2 0)?", "apsl 2 0"),
    ("blueoak-1.0", "blue oak", "blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"),
    ("cecill-2.1", "cecill", "cecill(?: free software)? license(?: agreement)?(?: version)?(?: 2 1)?", "cecill 2 1"),
    ("cecill-b", "cecill b", "cecill b(?: free software)?(?: license)?", "cecill b"),
    ("cecill-c", "cecill c", "cecill c(?: free software)?(?: license)?", "cecill c"),
    ("cern-ohl-s-2.0", "cern open hardware", "cern open hardware licen[cs]e (?:version )?(?:2 )?strongly reciprocal", "cern ohl s 2 0"),
    ("cern-ohl-w-2.0", "cern open hardware", "cern open hardware licen[cs]e (?:version )?(?:2 )?weakly reciprocal", "cern ohl w 2 0"),
    ("cern-ohl-p-2.0", "cern open hardware", "cern open hardware licen[cs]e (?:version )?(?:2 )?permissive", "cern ohl p 2 0"),
    ("cpal-1.0", "common public attribution", "common public attribution license(?: version)?(?: 1 0)?", "cpal 1 0"),
    ("etalab-2.0", "licence ouverte", "licence ouverte(?: (?:v|version )?2 0)?", "etalab 2 0"),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e(?: (?:v|version )?3 0)?", "ogl uk 3 0"),
    ("fdk-aac", "fdk aac", "fdk aac codec library", "fdk aac"),
    ("ftl", "freetype", "freetype (?:project )?license", "ftl"),
    ("ijg", "independent jpeg", "independent jpeg group (?:s )?(?:software|license)", "ijg"),
    ("ipl-1.0", "ibm public", "ibm public license(?: version)?(?: 1 0)?", "ipl 1 0"),
    ("jpl-image", "jpl image", "jpl image use policy", "jpl image"),
    ("json", "json license", "json license", "json"),
    ("latex-lppl-1.3c", "latex project", "latex project public license(?: (?:v|version )?1 3c?)?", "lppl 1 3c"),
    ("ms-lpl", "microsoft limited", "microsoft limited public license", "ms lpl"),
    ("motosoto", "motosoto", "motosoto open source license", "motosoto"),
    ("nasa-1.3", "nasa open source", "nasa open source agreement(?: (?:v|version )?1 3)?", "nasa 1 3"),
    ("nosl", "netizen", "netizen open source license", "nosl"),
    ("npl-1.1", "netscape", "netscape public license(?: (?:v|version )?1 1)?", "npl 1 1"),
    ("nposl-3.0", "non profit open", "non profit open software license(?: (?:version )?3 0)?", "nposl 3 0"),
    ("oclc-2.0", "oclc research", "oclc research public license(?: (?:version )?2 0)?", "oclc 2 0"),
    ("oset-pl-2.1", "oset public", "oset public license(?: (?:version )?2 1)?", "oset pl 2 1"),
    ("parity-7.0", "parity public", "parity public license(?: 7 0 0)?", "parity 7 0 0"),
    ("polyform-nc-1.0", "polyform noncommercial", "polyform noncommercial license(?: 1 0 0)?", "polyform noncommercial 1 0 0"),
    ("polyform-sb-1.0", "polyform small", "polyform small business license(?: 1 0 0)?", "polyform small business 1 0 0"),
    ("prosperity-3.0", "prosperity public", "prosperity public license(?: 3 0 0)?", "prosperity 3 0 0"),
    ("qpl-1.0", "q public", "q public license(?: (?:version )?1 0)?", "qpl 1 0"),
    ("rpl-1.5", "reciprocal public", "reciprocal public license(?: (?:version )?1 5)?", "rpl 1 5"),
    ("rpsl-1.0", "realnetworks", "realnetworks public source license(?: (?:v|version )?1 0)?", "rpsl 1 0"),
    ("simpl-2.0", "simple public", "simple public license(?: 2 0)?", "simpl 2 0"),
    ("sissl", "sun industry", "sun industry standards source license", "sissl"),
    ("sleepycat", "sleepycat", "sleepycat license", "sleepycat"),
    ("spl-1.0", "sun public", "sun public license(?: (?:v|version )?1 0)?", "spl 1 0"),
    ("tcl", "tcl tk", "tcl tk license", "tcl"),
    ("unicode-3.0", "unicode license", "unicode license(?: (?:v|version )?3)?", "unicode 3 0"),
    ("vim", "vim license", "vim license", "vim"),
    ("vsl-1.0", "vovida", "vovida software license(?: (?:v|version )?1 0)?", "vsl 1 0"),
    ("w3c", "w3c software", "w3c software (?:notice|and document)(?: notice)?(?: and)?(?: license)?", "w3c"),
    ("watcom-1.0", "sybase open watcom", "sybase open watcom public license(?: 1 0)?", "watcom 1 0"),
    ("wxwindows", "wxwindows", "wxwindows library licen[cs]e", "wxwindows"),
    ("x11", "x11 license", "x11 license", "x11"),
    ("xfree86-1.1", "xfree86", "xfree86 license(?: 1 1)?", "xfree86 1 1"),
    ("zpl-2.1", "zope public", "zope public license(?: (?:zpl )?(?:v|version )?2 1)?", "zpl 2 1"),
    ("anti-996", "996", "anti 996 license", "anti 996"),
    ("beerware", "ware", "(?:the )?beer ware license", "beerware"),
    ("hippocratic", "hippocratic", "hippocratic license(?: (?:version )?[1-3] [0-9])?", "hippocratic 2 1"),
    ("commons-clause", "commons clause", "commons clause(?: license)?(?: condition)?", "commons clause"),
    ("gemma", "gemma terms", "gemma terms of use", "gemma"),
    ("cdla-permissive-2.0", "community data", "community data license agreement permissive(?: (?:version )?2 0)?", "cdla permissive 2 0"),
    ("cdla-sharing-1.0", "community data", "community data license agreement sharing(?: (?:version )?1 0)?", "cdla sharing 1 0"),
    ("isc", "isc license", "isc license", "isc"),
    ("mpl-1.0", "mozilla", "mozilla public license (?:v|version )1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public license (?:v|version )1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license (?:v|version )2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license (?:v|version )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license (?:v|version )?2(?: 0)?", "epl 2 0"),
    ("cddl-1.0", "common development", "common development and distribution license(?: (?:v|version )1 0)?", "cddl 1 0"),
    ("cddl-1.1", "common development", "common development and distribution license (?:v|version )1 1", "cddl 1 1"),
    ("cpl-1.0", "common public", "common public license(?: (?:v|version )1 0)?", "cpl 1 0"),
    ("eupl-1.1", "european union public", "european union public licen[cs]e (?:v|version )?1 1", "eupl 1 1"),
    ("eupl-1.2", "european union public", "european union public licen[cs]e (?:v|version )?1 2", "eupl 1 2"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-1.0", "cc by", "cc by 1 0", "cc by 1 0"),
    ("cc-by-2.0", "cc by", "cc by 2 0", "cc by 2 0"),
    ("cc-by-3.0", "cc by", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc by", "cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "cc by sa", "cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", "cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "cc by nc", "cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd", "cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-attribution", "creative commons", "creative commons attribution(?: (?:[1-4] 0))?(?: international| unported| generic)?(?: license)?", "cc by 2 5"),
    ("cc-attribution-sharealike", "creative commons", "creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?(?: license)?", "cc by sa 2 5"),
    ("cc-attribution-noncommercial", "creative commons", "creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: license)?", "cc by nc 2 5"),
    ("artistic-1.0", "artistic", "artistic license 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license (?:version )?2 0", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software license(?: version 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business source", "business source license(?: 1 1)?", "busl 1 1"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl 2"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    ("libpng", "libpng", "libpng license", "libpng 2 0"),
    ("psf-2.0", "python software", "python software foundation license(?: version 2)?", "psf 2 0"),
    ("php-3.01", "php license", "php license(?: version 3 01)?", "php 3 01"),
    ("ruby", "ruby license", "ruby license", "ruby"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("odbl-1.0", "open database", "open (?:data commons )?open database license(?: 1 0)?|open database license(?: 1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", "open data commons attribution license(?: 1 0)?", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", "open data commons public domain dedication and license", "pddl 1 0"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?: (?:version )?1 1)?", "ofl 1 1"),
    ("osl-3.0", "open software", "open software license(?: (?:version )?3 0)?", "osl 3 0"),
    ("afl-3.0", "academic free", "academic free license(?: (?:version )?3 0)?", "afl 3 0"),
    ("ecl-2.0", "educational community", "educational community license(?: version 2 0)?", "ecl 2 0"),
    ("ncsa", "illinois", "university of illinois (?:ncsa )?open source license", "ncsa"),
    ("upl-1.0", "universal permissive", "universal permissive license(?: version 1 0| v 1 0)?", "upl 1 0"),
    ("mulan-psl-2.0", "mulan", "mulan (?:psl|permissive software license)(?: v2| version 2)?", "mulanpsl 2 0"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("sspl-1.0", "server side public", "server side public license(?: version 1)?", "sspl 1 0"),
    ("elastic-2.0", "elastic license", "elastic license(?: 2 0)?", "elastic 2 0"),
    ("openrail", "openrail", "(?:bigscience |creativeml )?openrail(?: m| license)+", "openrail"),
    ("llama", "community license", "llama [2-4](?: [0-9])? community license(?: agreement)?", "llama community"),
]

#: label, keyword, wording
NOTICES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mit", "the software is provided", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "the above copyright notice and this permission notice", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions"),
    ("isc", "the author disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "this software is provided by", "this software is provided by the (?:copyright holders?|regents|authors?) and contributors as is"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("lgpl", "gnu lesser general public", "free software foundation (?:\\S+ ){0,6}?gnu lesser general public license"),
    ("lgpl", "gnu library general public", "terms of the gnu library general public license"),
    ("lgpl-2.1-or-later", "lesser general public", "lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser general public", "lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "affero general public", "affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-1.0-or-later", "or at your option", "either version 1 (?:of the license )?or at your option any later version"),
    ("gpl-2.0-or-later", "gpl", "gpl (?:v2|2|2 0) or later"),
    ("gpl-2.0-or-later", "gplv2", "gplv2 or later"),
    ("gpl-3.0-or-later", "gplv3", "gplv3 or later"),
    ("gpl-2.0", "gplv2", "gplv2(?: only)?"),
    ("gpl-3.0", "gplv3", "gplv3(?: only)?"),
    ("agpl-3.0", "agplv3", "agplv3(?: only)?"),
    ("lgpl-2.1", "lgplv2", "lgplv2 1"),
    ("lgpl-3.0", "lgplv3", "lgplv3(?: only)?"),
    ("gpl-with-classpath-exception", "linking this library", "linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-with-gcc-exception", "runtime library exception", "gcc runtime library exception"),
    ("gpl-with-autoconf-exception", "autoconf", "as a special exception (?:\\S+ ){1,20}?configuration script generated by autoconf"),
    ("llvm-exception", "llvm", "apache 2 0 with llvm exceptions?"),
    ("gfdl", "invariant sections", "with no invariant sections (?:no|with no) front cover texts"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mpl-1.1", "subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla org mpl", "obtain one at (?:https?|http) mozilla org mpl 2 0"),
    ("epl-2.0", "eclipse org legal", "eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse org legal", "eclipse org legal epl v10"),
    ("cddl-1.0", "common development and distribution", "subject to the terms of the common development and distribution license"),
    ("artistic-2.0", "perl itself", "under the same terms as perl itself"),
    ("psf-2.0", "python software foundation", "copyright c (?:\\S+ ){1,30}?python software foundation all rights reserved"),
    ("php-3.01", "this product includes php", "this product includes php software freely available"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype project", "portions of this software are copyright (?:\\S+ ){1,6}?the freetype project"),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("ofl-1.1", "scripts sil org", "scripts sil org ofl"),
    ("json", "used for good", "the software shall be used for good not evil"),
    ("beerware", "in return", "you can buy me a beer in return"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("curl", "daniel stenberg", "copyright c (?:\\S+ ){1,12}?daniel stenberg"),
    ("hpnd", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("smlnj", "standard ml", "standard ml of new jersey copyright notice"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("unicode", "unicode data files", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ncsa", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "no rights reserved", "cc0 no rights reserved"),
    ("cc-by-nc-nd-4.0", "creativecommons org", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-3.0", "creativecommons org", "creativecommons org licenses by 3 0"),
    ("cc-by-2.0", "creativecommons org", "creativecommons org licenses by 2 0"),
    ("cc-by-nc-3.0", "creativecommons org", "creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-sa-3.0", "creativecommons org", "creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-nd-3.0", "creativecommons org", "creativecommons org licenses by nc nd 3 0"),
    ("cc-by-nd-3.0", "creativecommons org", "creativecommons org licenses by nd 3 0"),
    ("public-domain", "creativecommons org", "creativecommons org publicdomain mark 1 0"),
    ("cc-unspecified", "creative commons", "some rights reserved (?:\\S+ ){0,6}?creative commons|creative commons license"),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "opendatacommons", "opendatacommons org licenses by"),
    ("pddl-1.0", "opendatacommons", "opendatacommons org licenses pddl"),
    ("ogl-uk-3.0", "public sector information", "contains public sector information licensed under the open government licen[cs]e"),
    ("us-government", "title 17", "not subject to (?:united states )?copyright protection (?:\\S+ ){0,8}?title 17"),
    ("public-domain", "work of the united states", "work of the united states government"),
    ("public-domain", "to the public domain", "(?:i|we|the authors?) (?:hereby )?dedicates? (?:any and all copyright interest in )?this (?:software|work) to the public domain"),
    ("public-domain", "no copyright", "no copyright is claimed"),
    ("proprietary", "is strictly prohibited", "unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|material) (?:\\S+ ){0,6}?is strictly prohibited"),
    ("proprietary", "trade secrets", "(?:contains|constitutes?) (?:\\S+ ){0,6}?trade secrets"),
    ("proprietary", "prior written", "without (?:the )?(?:express |explicit )?prior written (?:permission|consent)"),
    ("proprietary", "end user license", "end user license agreement"),
    ("proprietary", "internal use only", "(?:for )?internal use only"),
    ("proprietary", "no part of this", "no part of this (?:publication|document|work|book) may be (?:reproduced|copied)"),
    ("personal-use", "personal use", "(?:for )?personal use only"),
    ("personal-use", "personal non commercial", "(?:for )?personal non commercial use"),
    ("academic-use", "academic", "(?:for )?academic (?:use|purposes) only"),
    ("research-use", "research", "(?:for )?(?:non commercial )?research (?:use|purposes) only"),
    ("educational-use", "educational", "(?:for )?educational (?:use|purposes) only"),
    ("evaluation-use", "evaluation", "(?:for )?evaluation (?:use|purposes) only"),
    ("no-derivatives", "derivative works", "(?:may not|must not|do not) (?:create|make|distribute) (?:any )?derivative works"),
    ("no-modification", "modify", "(?:may not|must not|do not) (?:alter or |adapt or )?modify(?: or (?:alter|adapt))? this"),
    ("no-modification", "alter", "(?:may not|must not|do not) alter(?: or (?:modify|adapt))? this"),
    ("no-training", "to train", "(?:may not|must not|shall not|do not) (?:be used|use (?:it|this)) to train"),
    ("no-training", "for training", "(?:may not|must not|shall not|do not) (?:be used|use (?:it|this)) for training"),
    ("no-mining", "mining", "text and data mining (?:is|are) (?:not permitted|reserved|prohibited)"),
    ("no-commercial", "commercial use", "(?:no commercial use|commercial use is (?:prohibited|not permitted|not allowed|forbidden))"),
    ("attribution-required", "provided the original", "provided the original (?:author|authors|work|source)(?: and source)? (?:is|are) (?:properly )?(?:cited|credited)"),
    ("bsd-3-clause", "neither the name", "neither the name of (?:\\S+ ){1,12}?may be used to endorse or promote products"),
    ("gpl", "free software you can redistribute", "(?:this|it) (?:program |library )?is free software you can redistribute it and or modify it"),
    ("gpl", "you should have received", "you should have received a copy of the gnu (?:lesser |affero )?general public license"),
    ("gpl-2.0-or-later", "or at your option", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "or at your option", "either version 3 of the license or at your option any later version"),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0"),
    ("apache-2.0", "except in compliance", "you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "creativecommons org", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons org", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons org", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons org", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org", "creativecommons org licenses by sa 3 0"),
    ("gpl", "gnu org licenses", "gnu org licenses(?: gpl)?"),
    ("boost", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "(?:is|are) in the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("no-redistribution", "redistribute", "(?:may not|must not|do not) redistribute"),
    ("no-redistribution", "redistributed", "(?:may not|must not) be redistributed"),
    ("non-commercial", "commercial", "(?:for )?non commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial", "(?:for )?noncommercial (?:use|purposes) only"),
]

#: The phrases that the contract of the licence query fixes, with their labels.
BASE: list[tuple[str, str]] = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

GRANT = "(?:licensed|released|distributed|available|published|provided|covered|redistributed) under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?"


def rules() -> list[Rule]:
    """All rules in order: identifiers, then grants, then notices, then bare names."""
    identifiers = [Rule(a, "spdx", f"spdx license identifier {d}(?: only)?(?! or later)", 0, 1.0) for a, _, _, d in FAMILIES]
    # the gnu families: a later version may be taken, which is another licence
    identifiers += [Rule(f"{a}-or-later", "spdx", f"spdx license identifier {d} or later", 0, 1.0) for a, _, _, d in FAMILIES if d[:3] in ("gpl", "lgp", "agp", "gfd")]
    grants = [Rule(a, k, f"{GRANT}(?:{n})", 1, 0.95) for a, k, n, _ in FAMILIES]
    notices = [Rule(a, k, n, 1, 0.9) for a, k, n in NOTICES]
    names = [Rule(a, k, n, 2, 0.7) for a, k, n, _ in FAMILIES]
    return identifiers + grants + notices + names
