"""License signature rules: phrases of notices over names of licenses, in order of priority.

Rules run over a text's lower-cased words joined by single spaces, with a space at either end.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

# Label, words of which each match of the name holds one at least as a whole word (glued forms are words of their own), name
# pattern, and whether the bare name is a sign of the license.
NAMES: list[tuple[str, str, str, bool]] = [
    ("mit", "mit", "mit", False),
    ("mit-0", "mit", "mit (?:no attribution|0)", True),
    ("x11", "x11", "x11", False),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version)? 1 1", True),
    ("apache-2", "apache apache2 apachev2", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?v?2(?: 0)?", True),
    ("bsd-2-clause", "bsd freebsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", True),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", True),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)", True),
    ("0bsd", "0bsd bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", True),
    ("bsd", "bsd", "bsd", False),
    ("isc", "isc", "isc", False),
    ("gpl-1", "gpl gplv gpl1 gplv1 gplvv1 general", "(?:gnu )?(?:general public licen[sc]e(?: version)?|gpl(?: version)?|gplv) ?v?1(?: 0)?", True),
    ("gpl-2", "gpl gplv gpl2 gplv2 gplvv2 general", "(?:gnu )?(?:general public licen[sc]e(?: version)?|gpl(?: version)?|gplv) ?v?2(?: 0)?", True),
    ("gpl-3", "gpl gplv gpl3 gplv3 gplvv3 general", "(?:gnu )?(?:general public licen[sc]e(?: version)?|gpl(?: version)?|gplv) ?v?3(?: 0)?", True),
    ("gpl", "gpl gnu", "(?:gnu general public|gnu gpl|gpl)", False),
    ("lgpl-2", "lgpl lgplv lgpl2 lgplv2 lgplvv2 lesser library", "(?:gnu )?(?:(?:lesser|library) general public licen[sc]e(?: version)?|lgpl(?: version)?|lgplv) ?v?2(?: 0)?", True),
    ("lgpl-2.1", "lgpl lgplv lgpl2 lgplv2 lgplvv2 lesser", "(?:gnu )?(?:lesser general public licen[sc]e(?: version)?|lgpl(?: version)?|lgplv) ?v?2 1", True),
    ("lgpl-3", "lgpl lgplv lgpl3 lgplv3 lgplvv3 lesser", "(?:gnu )?(?:lesser general public licen[sc]e(?: version)?|lgpl(?: version)?|lgplv) ?v?3(?: 0)?", True),
    ("lgpl", "lgpl lesser", "(?:gnu lesser general public|gnu lgpl|lgpl)", False),
    ("agpl-3", "agpl agplv agpl3 agplv3 agplvv3 affero", "(?:gnu )?(?:affero general public licen[sc]e(?: version)?|agpl(?: version)?|agplv) ?v?3(?: 0)?", True),
    ("agpl", "agpl affero", "(?:gnu affero general public|affero gpl|agpl)", False),
    ("gfdl", "gfdl documentation", "(?:gnu free documentation|gfdl)", False),
    ("mpl-1.1", "mpl mpl1 mplv1 mozilla", "(?:mozilla public licen[sc]e(?: version)?|mpl(?: version)?) ?v?1 1", True),
    ("mpl-2", "mpl mpl2 mplv2 mozilla", "(?:mozilla public licen[sc]e(?: version)?|mpl(?: version)?) ?v?2(?: 0)?", True),
    ("mpl", "mpl mozilla", "(?:mozilla public|mpl)", False),
    ("epl-1", "epl epl1 eplv1 eclipse", "(?:eclipse public licen[sc]e(?: version)?|epl(?: version)?) ?v?1(?: 0)?", True),
    ("epl-2", "epl epl2 eplv2 eclipse", "(?:eclipse public licen[sc]e(?: version)?|epl(?: version)?) ?v?2(?: 0)?", True),
    ("epl", "epl eclipse", "(?:eclipse public|epl)", False),
    ("eupl", "eupl european", "(?:european union public|eupl)(?: v?1 [12])?", False),
    ("cddl", "cddl development", "(?:common development and distribution|cddl)(?: v?1 [01])?", False),
    ("cpl", "cpl common", "(?:common public|cpl)(?: v?1 0)?", False),
    ("cc0", "cc0 zero", "(?:cc0(?: 1 0)?|creative commons zero)", True),
    ("cc-by-nc-nd", "cc creative", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [0-9])?", True),
    ("cc-by-nc-sa", "cc creative", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [0-9])?", True),
    ("cc-by-nc", "cc creative", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [0-9])?", True),
    ("cc-by-nd", "cc creative", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] [0-9])?", True),
    ("cc-by-sa", "cc creative", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [0-9])?", True),
    ("cc-by", "cc creative", "(?:cc by|creative commons attribution)(?: [1-4] [0-9])?", False),
    ("unlicense", "unlicense", "(?:the )?unlicense", True),
    ("wtfpl", "wtfpl fuck", "(?:wtfpl|do what the fuck you want to public)", True),
    ("zlib", "zlib", "(?:zlib(?: libpng)?)", False),
    ("libpng", "libpng", "libpng", False),
    ("boost-1", "boost bsl", "(?:boost software(?: licen[sc]e)?(?: version)?(?: 1 0)?|bsl 1 0)", True),
    ("artistic-1", "artistic artistic1 artisticv1", "artistic(?: licen[sc]e)?(?: version)? ?v?1(?: 0)?", True),
    ("artistic-2", "artistic artistic2 artisticv2", "artistic(?: licen[sc]e)?(?: version)? ?v?2(?: 0)?", True),
    ("python-2", "python python2 pythonv2 psf psf2 psfv2", "(?:python software foundation|psf|python)(?: licen[sc]e)?(?: version)? ?v?2(?: 0)?", True),
    ("php-3", "php php3 phpv3", "php(?: licen[sc]e)?(?: version)? ?v?3(?: 0[01]?)?", False),
    ("postgresql", "postgresql", "postgresql", False),
    ("openssl", "openssl", "openssl", False),
    ("ofl-1.1", "ofl sil", "(?:sil open font(?: licen[sc]e)?|ofl)(?: version)?(?: 1 1)?", True),
    ("ms-pl", "microsoft", "microsoft public", False),
    ("ms-rl", "microsoft", "microsoft reciprocal", False),
    ("odbl", "odbl database", "(?:open database|odbl)(?: v?1 0)?", False),
    ("odc-by", "odc commons", "(?:open data commons attribution|odc by)(?: v?1 0)?", False),
    ("pddl", "pddl dedication", "(?:public domain dedication and|pddl)(?: v?1 0)?", False),
    ("sspl", "sspl server", "(?:server side public|sspl)(?: v?1)?", False),
    ("busl-1.1", "busl business", "(?:business source(?: licen[sc]e)?(?: 1 1)?|busl 1 1)", True),
    ("elastic-2", "elastic elastic2 elasticv2", "elastic(?: licen[sc]e)?(?: version)? ?v?2(?: 0)?", True),
    ("openrail", "openrail rail", "(?:creativeml )?(?:open rail|openrail)(?: [mds]+)?", True),
    ("llama", "llama", "llama(?: [234])?(?: [0-9])? community", False),
    ("ncsa", "ncsa illinois", "(?:ncsa|university of illinois)(?: open source)?", False),
    ("cecill", "cecill", "cecill(?: [bc])?(?: v?[12](?: [01])?)?", True),
    ("mulan-2", "mulan", "mulan(?: permissive software)?(?: licen[sc]e)?(?: v?2)?", True),
    ("vim", "vim", "vim", False),
    ("json", "json", "json", False),
    ("beerware", "beerware beer", "(?:beerware|beer ware)", True),
]

# Priority, confidence, phrase; {} stands for the name.
PHRASES: list[tuple[int, float, str]] = [
    (1, 0.99, "spdx licen[sc]e identifier {}"),
    (2, 0.97, "(?:licen[sc]ed|released|distributed|available|published|provided|dual licen[sc]ed) (?:to you )?under (?:the )?(?:terms of (?:the )?)?{}(?: licen[sc]e)?"),
    (3, 0.95, "under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{} licen[sc]e"),
    (4, 0.9, "licen[sc]e {}"),
    (5, 0.85, "{} licen[sc]e"),
]
BARE = (6, 0.6, "{}")

# Rules of their own: label, keywords, priority, confidence, pattern.
TEXTS: list[tuple[str, str, int, float, str]] = [
    ("mit", "permission", 1, 0.99, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", 1, 0.99, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 1, 0.95, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "redistribute", 1, 0.95, "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", 1, 0.95, "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("agpl", "redistribute", 1, 0.95, "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("zlib", "misrepresented", 1, 0.95, "the origin of this software must not be misrepresented"),
    ("boost-1", "organization", 1, 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "unencumbered", 1, 0.97, "free and unencumbered software released into the public domain"),
    ("public-domain", "domain", 3, 0.8, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "reserved", 5, 0.5, "all rights reserved"),
    ("proprietary", "confidential proprietary", 4, 0.7, "(?:confidential and proprietary|proprietary and confidential)"),
    # MIT family
    ("mit", "permission", 1, 0.97, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", 2, 0.9, "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial", 3, 0.75, "(?:copyright|permission) notice shall be included in all copies or substantial portions"),
    ("mit-0", "sublicense", 1, 0.9, "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit-advertising", "advertising", 1, 0.9, "except as contained in this notice the name of .{1,80} shall not be used in advertising or otherwise to promote the sale"),
    ("x11", "consortium", 2, 0.9, "the name of the x consortium shall not be used in advertising"),
    ("x11-opengroup", "supporting", 2, 0.85, "that copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", "supporting", 3, 0.8, "both that copyright notice and this permission notice appear in supporting documentation"),
    ("expat", "expat", 2, 0.9, "expat licen[sc]e"),
    ("mit", "opensource", 2, 0.9, "opensource org licenses mit(?: license)?(?: php)?"),
    # ISC, NTP and relatives
    ("isc", "performance", 2, 0.8, "loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("ntp", "representations", 2, 0.85, "makes no representations about the suitability this software for any purpose"),
    ("hpnd", "representations", 3, 0.75, "makes no representations about the suitability of this software for any purpose"),
    ("0bsd", "fee", 2, 0.8, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    # BSD clauses
    ("bsd", "redistributions", 2, 0.85, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 2, 0.85, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", 2, 0.9, "neither the names? of .{1,120} may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", 3, 0.8, "may (?:not )?be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", "advertising", 2, 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause-uc", "regents", 2, 0.9, "the regents of the university of california all rights reserved"),
    ("bsd-3-clause-clear", "patent", 2, 0.85, "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-2-clause-patent", "patent", 2, 0.85, "hereby grants to those receiving rights under this licen[sc]e a perpetual worldwide non exclusive no charge royalty free irrevocable(?: .{1,80})? patent licen[sc]e"),
    ("bsd-3-clause-attribution", "developed", 3, 0.8, "redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by"),
    ("bsd", "style", 3, 0.8, "bsd style licen[sc]e"),
    ("bsd-3-clause-no-nuclear", "nuclear", 2, 0.9, "not designed licen[sc]ed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    # Apache
    ("apache-2", "apache", 1, 0.99, "licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", "compliance", 2, 0.85, "you may not use this (?:file|work|software) except in compliance with the licen[sc]e"),
    ("apache-2", "apache", 2, 0.95, "apache org licenses license 2 0"),
    ("apache-2", "limitations", 2, 0.8, "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2", "contributor", 2, 0.9, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-2", "asf", 2, 0.9, "licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-1.1", "apache", 2, 0.9, "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", 2, 0.9, "this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-2", "asl", 3, 0.85, "asl (?:version )?2(?: 0)?"),
    ("apache", "apache", 6, 0.5, "apache software foundation"),
    # GNU, with what follows a version
    ("gpl-1-or-later", "general", 1, 0.97, "gnu general public licen[sc]e as published by the free software foundation either version 1 of the licen[sc]e or at your option any later version"),
    ("gpl-2-or-later", "general", 1, 0.98, "gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3-or-later", "general", 1, 0.98, "gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-2-only", "general", 1, 0.97, "under the terms of the gnu general public licen[sc]e version 2 as published by the free software foundation"),
    ("gpl-2-only", "general", 1, 0.97, "under version 2 of the gnu general public licen[sc]e"),
    ("gpl-3-only", "general", 1, 0.97, "under version 3 of the gnu general public licen[sc]e"),
    ("gpl-2-only", "gpl", 1, 0.97, "gpl 2 0 only"),
    ("gpl-2-or-later", "gpl", 1, 0.97, "gpl 2 0 or later"),
    ("gpl-3-only", "gpl", 1, 0.97, "gpl 3 0 only"),
    ("gpl-3-or-later", "gpl", 1, 0.97, "gpl 3 0 or later"),
    ("lgpl-2-or-later", "library", 1, 0.97, "gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1-or-later", "lesser", 1, 0.98, "gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version"),
    ("lgpl-3-or-later", "lesser", 1, 0.98, "gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1-only", "lgpl", 1, 0.97, "lgpl 2 1 only"),
    ("lgpl-2.1-or-later", "lgpl", 1, 0.97, "lgpl 2 1 or later"),
    ("lgpl-3-only", "lgpl", 1, 0.97, "lgpl 3 0 only"),
    ("lgpl-3-or-later", "lgpl", 1, 0.97, "lgpl 3 0 or later"),
    ("agpl-3-or-later", "affero", 1, 0.98, "gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("agpl-3-only", "agpl", 1, 0.97, "agpl 3 0 only"),
    ("agpl-3-or-later", "agpl", 1, 0.97, "agpl 3 0 or later"),
    ("gpl", "merchantability", 3, 0.8, "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
    ("lgpl", "merchantability", 3, 0.8, "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public licen[sc]e"),
    ("agpl", "merchantability", 3, 0.8, "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public licen[sc]e"),
    ("gpl", "received", 3, 0.8, "you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", "received", 3, 0.8, "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "received", 3, 0.8, "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl", "gnu", 3, 0.8, "gnu org licenses(?: old licenses)? gpl(?: [23] 0)?(?: html| txt)?"),
    ("lgpl", "gnu", 3, 0.8, "gnu org licenses(?: old licenses)? lgpl(?: [23] [01])?(?: html| txt)?"),
    ("gpl-1", "1989", 2, 0.9, "gnu general public licen[sc]e version 1 february 1989"),
    ("gpl-2", "1991", 2, 0.95, "gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-3", "2007", 2, 0.95, "gnu general public licen[sc]e version 3 29 june 2007"),
    ("lgpl-2", "1991", 2, 0.95, "gnu library general public licen[sc]e version 2 june 1991"),
    ("lgpl-2.1", "1999", 2, 0.95, "gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl-3", "2007", 2, 0.95, "gnu lesser general public licen[sc]e version 3 29 june 2007"),
    ("agpl-3", "2007", 2, 0.95, "gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("gfdl-1.2", "documentation", 1, 0.95, "gnu free documentation licen[sc]e version 1 2"),
    ("gfdl-1.3", "documentation", 1, 0.95, "gnu free documentation licen[sc]e version 1 3"),
    ("gfdl", "invariant", 2, 0.85, "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-3", "tivoization", 6, 0.4, "anti tivoization"),
    # Exceptions
    ("classpath-exception", "classpath", 1, 0.95, "classpath exception(?: 2 0)?"),
    ("classpath-exception", "independent", 2, 0.85, "gives you permission to link this library with independent modules to produce an executable"),
    ("gcc-exception", "gcc", 1, 0.95, "gcc (?:runtime library )?exception(?: [23] [01])?"),
    ("linking-exception", "linking", 3, 0.8, "(?:static |dynamic )?linking exception"),
    ("font-exception", "font", 2, 0.9, "font exception(?: 2 0)?"),
    ("font-exception", "font", 2, 0.85, "this font does not by itself cause the resulting document to be covered by the gnu general public licen[sc]e"),
    ("llvm-exception", "llvm", 1, 0.95, "(?:with )?llvm exceptions?"),
    ("linux-syscall-note", "syscall", 1, 0.95, "linux syscall note"),
    ("bison-exception", "bison", 1, 0.9, "bison exception(?: 2 2)?"),
    ("autoconf-exception", "autoconf", 1, 0.9, "autoconf exception(?: [23] 0)?"),
    ("openssl-exception", "openssl", 2, 0.85, "permission to link(?: the code of)?(?: .{1,60})? with the openssl (?:project s )?(?:openssl )?library"),
    ("qt-exception", "qt", 1, 0.9, "(?:digia qt|qt company) (?:lgpl|gpl) exception"),
    ("swift-exception", "swift", 1, 0.9, "swift exception"),
    ("universal-foss-exception", "foss", 1, 0.9, "universal foss exception"),
    # Mozilla, Eclipse and other file-level ones
    ("mpl-2", "mozilla", 1, 0.98, "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0"),
    ("mpl-2", "mpl", 2, 0.9, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2-no-copyleft-exception", "secondary", 1, 0.95, "this source code form is incompatible with secondary licenses as defined by the mozilla public licen[sc]e"),
    ("mpl-1.1", "mozilla", 1, 0.97, "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-1.0", "mozilla", 1, 0.97, "the contents of this file are subject to the mozilla public licen[sc]e version 1 0"),
    ("npl-1.1", "netscape", 1, 0.95, "the contents of this file are subject to the netscape public licen[sc]e version 1 1"),
    ("mpl", "tri", 3, 0.8, "mpl gpl lgpl tri licen[sc]e"),
    ("epl-1", "eclipse", 1, 0.97, "made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?1 0"),
    ("epl-2", "eclipse", 1, 0.97, "made available under the terms of the eclipse public licen[sc]e (?:v ?|version )?2 0"),
    ("epl", "accompanies", 3, 0.75, "eclipse public licen[sc]e(?: .{1,20})? which accompanies this distribution"),
    ("edl-1", "eclipse", 1, 0.95, "eclipse distribution licen[sc]e(?: version| v)? ?1 0"),
    ("cddl", "development", 1, 0.95, "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl-1", "development", 2, 0.9, "common development and distribution licen[sc]e(?: cddl)? version 1 0"),
    ("cddl-1.1", "development", 2, 0.9, "common development and distribution licen[sc]e(?: cddl)? version 1 1"),
    ("cpal-1", "attribution", 2, 0.9, "common public attribution licen[sc]e(?: version)? 1 0"),
    ("cpl-1", "common", 2, 0.9, "this program is (?:provided|made available) under the terms of (?:this|the) common public licen[sc]e"),
    ("ipl-1", "ibm", 2, 0.9, "ibm public licen[sc]e(?: version)? 1 0"),
    ("apsl-2", "apple", 2, 0.9, "apple public source licen[sc]e(?: version)? 2 0"),
    ("osl-3", "osl software", 2, 0.9, "open software licen[sc]e(?: osl)?(?: version| v)? ?3 0|osl 3 0"),
    ("afl-3", "academic", 2, 0.9, "academic free licen[sc]e(?: version| v)? ?3 0"),
    ("qpl-1", "q", 2, 0.85, "q public licen[sc]e(?: version)? 1 0"),
    ("rpl-1.5", "reciprocal", 2, 0.9, "reciprocal public licen[sc]e(?: version)? 1 5"),
    ("nasa-1.3", "nasa", 2, 0.9, "nasa open source agreement(?: version)? 1 3"),
    ("sissl", "sun", 2, 0.9, "sun industry standards source licen[sc]e"),
    ("eupl-1.2", "eupl", 1, 0.95, "licensed under the eupl(?: version)? 1 2"),
    ("eupl-1.1", "eupl", 1, 0.95, "licensed under the eupl(?: version)? 1 1"),
    ("osl", "osl", 6, 0.5, "osl (?:1|2) [01]"),
    # Permissive of their own wording
    ("zlib", "altered", 2, 0.9, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "warranty", 3, 0.75, "provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("libtiff", "sam", 2, 0.85, "the names of sam leffler and silicon graphics may not be used"),
    ("bzip2", "bzip2", 2, 0.9, "bzip2 (?:and libbzip2 )?licen[sc]e(?: v)?(?: ?1 0 [56])?"),
    ("curl", "curl", 2, 0.85, "curl licen[sc]e"),
    ("fsf-all-permissive", "copying", 2, 0.9, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", "configure", 2, 0.85, "this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it"),
    ("boost-1", "boost", 1, 0.97, "distributed under the boost software licen[sc]e version 1 0"),
    ("ftl", "freetype", 2, 0.9, "(?:the )?freetype (?:project )?licen[sc]e"),
    ("icu", "icu", 2, 0.85, "icu licen[sc]e"),
    ("unicode", "unicode", 2, 0.9, "unicode (?:licen[sc]e agreement data files and software|inc licen[sc]e agreement|licen[sc]e v3|dfs 201[56])"),
    ("w3c", "w3c", 2, 0.9, "w3c software (?:and document )?(?:notice and )?licen[sc]e"),
    ("upl-1", "universal", 2, 0.9, "universal permissive licen[sc]e(?: upl)?(?: version| v)? ?1 0"),
    ("blueoak-1", "oak", 2, 0.9, "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("postgresql", "paragraphs", 2, 0.85, "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ruby", "ruby", 2, 0.85, "(?:under the )?ruby(?: s)? licen[sc]e"),
    ("perl", "perl", 2, 0.9, "(?:under the )?same terms as perl(?: itself)?"),
    ("artistic-1-perl", "artistic", 2, 0.9, "either the perl artistic licen[sc]e or the gpl|artistic licen[sc]e perl 1 0"),
    ("tcl", "tcl", 3, 0.75, "tcl tk licen[sc]e"),
    ("imagemagick", "imagemagick", 2, 0.85, "imagemagick licen[sc]e"),
    ("openldap-2.8", "openldap", 2, 0.9, "openldap public licen[sc]e(?: version)?(?: 2 8)?"),
    ("intel-acpi", "intel", 4, 0.6, "intel acpi licen[sc]e"),
    ("naist-2003", "naist nara", 2, 0.85, "nara institute of science and technology|naist 2003"),
    ("clear-bsd", "clear", 2, 0.85, "clear bsd licen[sc]e"),
    ("afm", "adobe", 4, 0.6, "adobe (?:glyph list|utopia|systems incorporated) licen[sc]e"),
    # Creative Commons and data
    ("cc0", "waived", 1, 0.95, "has waived all copyright and related or neighboring rights"),
    ("cc0", "publicdomain", 1, 0.95, "creativecommons org publicdomain zero 1 0"),
    ("public-domain-mark", "publicdomain", 1, 0.95, "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", 1, 0.95, "creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons", 1, 0.96, "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons", 1, 0.96, "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons", 1, 0.96, "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons", 1, 0.97, "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons", 1, 0.97, "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by", "attribution", 3, 0.85, "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)"),
    ("cc-by-sa", "sharealike", 3, 0.85, "attribution sharealike(?: [1-4] [05])?(?: international| unported| generic)"),
    ("cc-by-nc-sa", "noncommercial", 3, 0.85, "attribution noncommercial sharealike(?: [1-4] [05])?(?: international| unported| generic)"),
    ("cc-by-nc-nd", "noncommercial", 3, 0.85, "attribution noncommercial noderivatives(?: [1-4] [05])?(?: international)?"),
    ("cc-sampling", "sampling", 3, 0.8, "creative commons sampling(?: plus)?(?: 1 0)?"),
    ("odbl", "opendatacommons", 1, 0.95, "opendatacommons org licenses odbl"),
    ("pddl", "opendatacommons", 1, 0.95, "opendatacommons org licenses pddl"),
    ("odc-by", "opendatacommons", 1, 0.95, "opendatacommons org licenses by"),
    ("cdla-permissive-2", "data", 2, 0.9, "community data licen[sc]e agreement permissive(?: version)?(?: 2 0)?"),
    ("cdla-sharing-1", "data", 2, 0.9, "community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?"),
    ("ogl-uk-3", "government", 2, 0.9, "open government licen[sc]e(?: v?3 0)?"),
    ("etalab-2", "etalab", 2, 0.9, "licence ouverte(?: open licence)? etalab|etalab (?:2 0|open licence)"),
    ("dl-de-by-2", "deutschland", 2, 0.9, "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("c-uda-1", "computational", 2, 0.9, "computational use of data agreement"),
    # Models
    ("openrail-m", "rail", 2, 0.9, "bigscience (?:open )?rail(?: m)?(?: v?1 0)?"),
    ("bigcode-openrail-m", "bigcode", 2, 0.9, "bigcode open ?rail m"),
    ("gemma", "gemma", 2, 0.85, "gemma terms of use"),
    ("llama-2", "llama", 1, 0.95, "llama 2 community licen[sc]e agreement"),
    ("llama-3", "llama", 1, 0.95, "(?:meta )?llama 3 community licen[sc]e agreement"),
    ("research-only", "research", 4, 0.6, "for (?:non ?commercial )?research purposes only"),
    # Source available, reserved and other
    ("sspl", "sspl server", 1, 0.95, "server side public licen[sc]e(?: version| v)? ?1|sspl 1 0"),
    ("busl-1.1", "change", 3, 0.75, "change date .{1,40} change licen[sc]e"),
    ("commons-clause", "clause", 1, 0.95, "commons clause(?: licen[sc]e)? condition|the commons clause"),
    ("elastic-2", "managed", 2, 0.85, "you may not provide the software to third parties as a hosted or managed service"),
    ("polyform-noncommercial", "polyform", 1, 0.95, "polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?"),
    ("polyform-small-business", "polyform", 1, 0.95, "polyform small business(?: licen[sc]e)?(?: 1 0 0)?"),
    ("prosperity-3", "prosperity", 1, 0.9, "prosperity public licen[sc]e(?: 3 0 0)?"),
    ("parity-7", "parity", 1, 0.9, "parity public licen[sc]e(?: 7 0 0)?"),
    ("jrl", "java", 3, 0.8, "java research licen[sc]e"),
    ("sun-bcl", "binary", 3, 0.85, "sun microsystems inc binary code licen[sc]e agreement"),
    ("json", "evil", 2, 0.95, "the software shall be used for good not evil"),
    ("wtfpl", "fuck", 1, 0.97, "you just do what the fuck you want to"),
    ("beerware", "beer", 2, 0.9, "you can buy me a beer in return"),
    ("unlicense", "unlicense", 1, 0.95, "unlicense org"),
    ("unlicense", "dedicate", 2, 0.85, "dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", "domain", 3, 0.75, "this (?:file|work|software|code|program) is in the public domain"),
    ("public-domain", "disclaims", 3, 0.8, "the author (?:hereby )?disclaims copyright to this source code"),
    ("public-domain", "uncopyrighted", 4, 0.7, "uncopyrighted"),
    ("us-government-work", "government", 3, 0.8, "(?:work|works) of the (?:united states|u s|us) government"),
    ("proprietary", "reproduced", 4, 0.65, "no part of this .{1,40} may be reproduced"),
    ("proprietary", "unauthorized", 4, 0.65, "unauthorized (?:copying|reproduction|use|distribution)(?: .{1,60})?(?: is)?(?: strictly)? prohibited"),
    ("proprietary", "eula", 4, 0.6, "end user licen[sc]e agreement eula|eula"),
    ("commercial", "commercial", 4, 0.6, "commercial licen[sc]e (?:agreement|is required|required)"),
    ("free-trial", "trial", 5, 0.4, "(?:free )?trial licen[sc]e"),
    # Expressions of several licenses
    ("mit or apache-2", "apache", 1, 0.98, "(?:mit or apache 2 0|apache 2 0 or mit)"),
    ("mit or gpl-2", "gpl", 1, 0.95, "(?:dual licensed under the )?mit (?:and|or) gpl(?: v?2(?: 0)?)?(?: licenses)?"),
    ("gpl-2 with classpath-exception", "classpath", 1, 0.98, "gpl 2 0 (?:only |or later )?with classpath exception 2 0"),
    ("apache-2 with llvm-exception", "llvm", 1, 0.98, "apache 2 0 with llvm exception"),
    ("gpl-3 with gcc-exception", "gcc", 1, 0.98, "gpl 3 0 (?:only |or later )?with gcc exception 3 1"),
    ("gpl-2 with linux-syscall-note", "syscall", 1, 0.98, "gpl 2 0 (?:only |or later )?with linux syscall note"),
    ("mpl-2 or eupl", "eupl", 2, 0.9, "mpl 2 0 or eupl 1 [12]"),
    ("bsd-3-clause or gpl-2", "bsd", 1, 0.95, "(?:bsd 3 clause or gpl 2 0|gpl 2 0 or bsd 3 clause)(?: only| or later)?"),
    ("unidentified", "identifier", 5, 0.4, "spdx licen[sc]e identifier"),
]

# Phrases whose every place counts, and their labels.
BASE: list[tuple[str, str, str]] = [("mit", "mit", "under the mit license"), ("apache-2", "apache", "apache license version 2"), ("cc-by-nc", "nc", "cc by nc")]


class Rule(NamedTuple):
    label: str
    keywords: frozenset[str]
    priority: int
    confidence: float
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, most important first; within a priority in the order of the tables."""
    out = []
    for (label, words, name, bare), (priority, confidence, phrase) in itertools.product(NAMES, [*PHRASES, BARE]):
        if (priority, confidence, phrase) != BARE or bare:
            out.append(Rule(label, frozenset(words.split()), priority, confidence, re.compile(f"(?<= ){phrase.replace('{}', f'(?:{name})')}(?= )")))
    out += [Rule(label, frozenset(words.split()), priority, confidence, re.compile(f"(?<= )(?:{text})(?= )")) for label, words, priority, confidence, text in TEXTS]
    return sorted(out, key=lambda r: r.priority)
