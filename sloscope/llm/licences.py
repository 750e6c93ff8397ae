r"""License scans by ordered signature rules with a keyword prefilter.

Texts become lines of lower-case words of letters and digits. A rule is a label, a
keyword that every match contains, and a regular expression over whole words; one pass
of an automaton finds a text's keywords, and only their rules are tried. Rules stand in order of priority: a detection inside the words
of one with a higher rank is suppressed. The four base phrases are always reported.

Defined cases: a null text counts as empty. Case folding is A-Z only; characters above
U+007F belong to words. A text of twice the length takes about twice the time, however
many licenses it names. Repeated rows and null ids get a row each; an empty table none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import table

#: Fixed values of the contract: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, keyword, name and versions of each license. A version follows the label after
#: a hyphen; ``v`` stands for where it may follow the name in other words.
FAMILIES = (
    ("gpl", "general public", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e", "1.0 2.0 3.0"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", "2.1 3.0"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e", "2.0 2.1"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "1.0 3.0"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?: software)?(?: licen[cs]e)?", "1.0 1.1 2.0"),
    ("mit", "mit licen", r"mit licen[cs]e", ""),
    ("mit", "mit x11", r"mit x11 licen[cs]e", ""),
    ("mit", "expat", r"expat licen[cs]e", ""),
    ("x11", "x11", r"x11 licen[cs]e", ""),
    ("isc", "isc", r"isc licen[cs]e", ""),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd) licen[cs]e", ""),
    ("bsd-2-clause", "clause", r"(?:bsd )?(?:2|two) clause(?: bsd)? licen[cs]e", ""),
    ("bsd-3-clause", "bsd", r"(?:new bsd|revised bsd|modified bsd) licen[cs]e", ""),
    ("bsd-3-clause", "clause", r"(?:bsd )?(?:3|three) clause(?: bsd)? licen[cs]e", ""),
    ("bsd-4-clause", "bsd", r"original bsd licen[cs]e", ""),
    ("bsd-4-clause", "clause", r"(?:bsd )?(?:4|four) clause(?: bsd)? licen[cs]e", ""),
    ("0bsd", "0bsd", r"0bsd(?: licen[cs]e)?", ""),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", ""),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "1.0 2.0"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", "1.0"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "1.0 1.1"),
    ("cddl", "cddl", r"cddl", "1.0 1.1"),
    ("cpl", "common public", r"common public licen[cs]e", "1.0"),
    ("ipl", "ibm public", r"ibm public licen[cs]e", "1.0"),
    ("eupl", "european union", r"european union public licen[cs]e", "1.0 1.1 1.2"),
    ("eupl", "eupl", r"eupl", "1.0 1.1 1.2"),
    ("artistic", "artistic", r"artistic licen[cs]e", "1.0 2.0"),
    ("osl", "open software", r"open software licen[cs]e", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free", r"academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("bsl", "boost", r"boost software licen[cs]e", "1.0"),
    ("busl", "business source", r"business source licen[cs]e", "1.1"),
    ("sspl", "server side", r"server side public licen[cs]e", "1.0"),
    ("elastic", "elastic", r"elastic licen[cs]e", "1.0 2.0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ""),
    ("libpng", "libpng", r"libpng licen[cs]e", "2.0"),
    ("php", "php", r"php licen[cs]e", "3.0 3.01"),
    ("psf", "python", r"python(?: software foundation)? licen[cs]e", "2.0"),
    ("ruby", "ruby", r"ruby licen[cs]e", ""),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", ""),
    ("openssl", "openssl", r"openssl licen[cs]e", ""),
    ("vim", "vim", r"vim licen[cs]e", ""),
    ("w3c", "w3c", r"w3c(?: software(?: notice)?(?: and)?)? licen[cs]e", ""),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ""),
    ("zpl", "zope", r"zope public licen[cs]e", "1.1 2.0 2.1"),
    ("qpl", "q public", r"q public licen[cs]e", "1.0"),
    ("lppl", "latex", r"latex project public licen[cs]e", "1.0 1.1 1.2 1.3"),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?", "1.0 1.1 2.0 2.1"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", ""),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "1.0"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl)(?: licen[cs]e)?", "1.0 2.0"),
    ("wtfpl", "wtfpl", r"wtfpl", "1.0 2.0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("json", "json", r"json licen[cs]e", ""),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", ""),
    ("odbl", "open database", r"open database licen[cs]e", "1.0"),
    ("odc-by", "data commons", r"open data commons attribution licen[cs]e", "1.0"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", "1.0"),
    ("cc0", "cc0", r"cc0(?: universal)?", "1.0"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc by", r"cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc by", r"cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc by", r"cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "cc by", r"cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative|ativework|ative work)?s(?: international)?(?: licen[cs]e)?", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: international)?(?: licen[cs]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: international)?(?: licen[cs]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative|ativework|ative work)?s(?: international)?(?: licen[cs]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: international)?(?: licen[cs]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: international)?(?: licen[cs]e)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc", "creative commons", r"creative commons(?: licen[cs]e)?", ""),
)

#: How a license is named: template and confidence, the surest first. ``{n}`` is the name with its version.
FORMS = (
    (r"(?:this|the) (?:work|program|software|file|project|code|library|document|material|content|data|dataset|package|module|text)s? (?:is|are) (?:licensed|released|distributed|made available|published|provided|free software) (?:to you )?under (?:the )?(?:terms of )?(?:the )?{n}", 1.0),
    (r"spdx license identifier {n}", 1.0),
    (r"(?:dual )?(?:licensed|released|distributed|available|published|provided|redistributable) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n}", 0.95),
    (r"licen[cs]e {n}", 0.85),
    (r"{n}", 0.7),
)

#: Hand-written signatures, fixed values from the licenses' public texts, notices, addresses and
#: names: label, keyword, expression, confidence. Of two that start alike the narrower comes first.
PASSAGES = (
    ("0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 1.0),
    ("postgresql", "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "systems consortium", r"internet systems consortium(?: inc)? disclaims all warranties", 0.95),
    ("hpnd", "and its documentation", r"permission to use copy modify(?: distribute and sell| and distribute) this software and its documentation for any purpose(?: and without fee)? is hereby granted", 0.95),
    ("hpnd", "suitability of this", r"makes? no representations about the suitability of this software for any purpose", 0.85),
    ("upl-1.0", "associated documentation", r"any person obtaining a copy of this software associated documentation and or data collectively the software", 1.0),
    ("unicode", "unicode data", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    ("bsl-1.0", "or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1.0),
    ("bsl-1.0", "machine executable", r"machine executable object code generated by a source language processor", 0.9),
    ("bsl-1.0", "accompanying file", r"see accompanying file licen[cs]e 1 0 txt", 0.9),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit-0", "furnished to do", r"permit persons to whom the software is furnished to do so the software is provided as is", 0.95),
    ("mit", "merge publish", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e", 0.95),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "and noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement", 0.7),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising or otherwise to promote", 0.95),
    ("json", "not evil", r"the software shall be used for good not evil", 1.0),
    ("ncsa", "deal with the", r"to deal with the software without restriction including without limitation the rights to use", 0.9),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd", "of source code must", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", "binary form must", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd-2-clause-views", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors", 0.95),
    ("bsd-3-clause", "endorse or promote", r"neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products", 0.95),
    ("bsd-3-clause-clear", "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this licen[cs]e", 1.0),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("sleepycat", "db software", r"information on how to obtain complete source code for the db software", 1.0),
    ("apache-1.0", "be called apache", r"products derived from this software may not be called apache", 0.95),
    ("apache-1.1", "end user documentation", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment", 0.95),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.9),
    ("apache-2.0", "required by applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 0.95),
    ("apache-2.0", "no charge royalty", r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) licen[cs]e", 0.9),
    ("apache-2.0", "notice text file", r"if the work includes a notice text file as part of its distribution", 0.95),
    ("apache-2.0", "language governing permissions", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e", 0.9),
    ("llvm-exception", "of your compiling", r"as an exception if as a result of your compiling your source code portions of this software are embedded", 1.0),
    ("gpl", "free software you", r"(?:this program is )?free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("gpl", "along with this", r"you should have received a copy of the gnu general public licen[cs]e along with this", 1.0),
    ("gpl-2.0", "take away your", r"the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("gpl-2.0", "activities other than", r"activities other than copying distribution and modification are not covered by this licen[cs]e", 0.95),
    ("gpl-2.0", "recipients exercise", r"you may not impose any further restrictions on the recipients exercise of the rights granted herein", 0.85),
    ("gpl-3.0", "free copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("gpl-3.0", "convey verbatim", r"you may convey verbatim copies of the program s source code as you receive it", 0.95),
    ("gpl-3.0", "to propagate", r"to propagate a work means to do anything with it that without permission would make you", 0.95),
    ("classpath-exception", "statically or dynamically", r"linking this library statically or dynamically with other modules is making a combined work", 1.0),
    ("gcc-exception", "gcc runtime", r"gcc runtime library exception", 1.0),
    ("bison-exception", "bison parser", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 1.0),
    ("lgpl", "free software you", r"(?:this library is )?free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 1.0),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", 1.0),
    ("lgpl-2.1", "specially designated", r"the lesser general public license applies to some specially designated software packages", 1.0),
    ("lgpl-2.0", "specially designated", r"the library general public license applies to some specially designated free software foundation software", 1.0),
    ("lgpl-3.0", "incorporates the terms", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 1.0),
    ("agpl", "free software you", r"(?:this program is )?free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 1.0),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e", 1.0),
    ("agpl-3.0", "network server software", r"specifically designed to ensure cooperation with the community in the case of network server software", 1.0),
    ("agpl-3.0", "interacting with it", r"all users interacting with it remotely through a computer network", 0.9),
    ("gfdl", "modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1.0),
    ("gfdl", "invariant sections", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", 0.95),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 1.0),
    ("mpl-2.0", "copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-2.0", "secondary licenses", r"incompatible with secondary licenses", 0.9),
    ("mpl", "mozilla public", r"the contents of this file are subject to the mozilla public licen[cs]e", 1.0),
    ("mpl-1.1", "governing rights", r"see the licen[cs]e for the specific language governing rights and limitations under the licen[cs]e", 0.8),
    ("npl", "netscape public", r"netscape public licen[cs]e", 0.9),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 1.0),
    ("epl", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e", 1.0),
    ("cpl", "accompanying program", r"the accompanying program is provided under the terms of this common public licen[cs]e", 1.0),
    ("ipl", "accompanying program", r"the accompanying program is provided under the terms of this ibm public licen[cs]e", 1.0),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 1.0),
    ("eupl", "licensor hereby grants", r"the licensor hereby grants you a world ?wide royalty free non exclusive sub ?licen[cs]able licen[cs]e", 0.95),
    ("artistic-1.0", "package may be copied", r"the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic-2.0", "given free software", r"this license establishes the terms under which a given free software package may be copied", 1.0),
    ("perl", "same terms as perl", r"you can redistribute it and or modify it under the same terms as perl(?: 5)?(?: programming language)?(?: system)? itself", 1.0),
    ("ofl", "font software", r"this font software is licensed under the sil open font licen[cs]e", 1.0),
    ("ofl", "font software", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", 1.0),
    ("bitstream-vera", "font software typefaces", r"no copy of one or more of the font software typefaces may be sold by itself", 1.0),
    ("busl", "non production use", r"the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("sspl", "functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service", 1.0),
    ("elastic-2.0", "hosted or managed", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?", 0.9),
    ("commons-clause", "right to sell", r"the licen[cs]e does not grant to you the right to sell the software", 1.0),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial licen[cs]e", 1.0),
    ("polyform-small-business", "polyform", r"polyform small business licen[cs]e", 1.0),
    ("polyform-shield", "polyform", r"polyform shield licen[cs]e", 1.0),
    ("zlib", "as is without", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("zlib", "origin of this", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "commercial applications", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 1.0),
    ("libpng", "png reference", r"the png reference library is supplied as is", 1.0),
    ("ijg", "jpeg group", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", "freetype", r"portions of this software are copyright(?: [^ ]+){0,6} the freetype project", 1.0),
    ("php", "php software", r"this product includes php software freely available from", 1.0),
    ("psf", "psf hereby", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e", 1.0),
    ("cnri-python", "cnri hereby", r"cnri hereby grants licensee a nonexclusive royalty free world wide licen[cs]e", 1.0),
    ("beopen-python", "beopen", r"beopen(?: com)? hereby grants licensee a non exclusive royalty free world wide licen[cs]e", 1.0),
    ("ruby", "give away verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction", 0.9),
    ("openssl", "openssl toolkit", r"software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 1.0),
    ("vim", "copies of vim", r"there are no restrictions on distributing unmodified copies of vim", 1.0),
    ("w3c", "fee or royalty", r"permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted", 1.0),
    ("tcl", "sun microsystems", r"this software is copyrighted by the regents of the university of california sun microsystems", 1.0),
    ("lppl", "latex project", r"this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", 1.0),
    ("lppl", "maintenance status", r"this work has the lppl maintenance status", 1.0),
    ("cecill-b", "french law", r"this software is governed by the cecill b licen[cs]e under french law", 1.0),
    ("cecill-c", "french law", r"this software is governed by the cecill c licen[cs]e under french law", 1.0),
    ("cecill", "french law", r"this software is governed by the cecill licen[cs]e under french law", 1.0),
    ("ms-pl", "governs use", r"this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("mulan", "mulan", r"you can use this software according to the terms and conditions of the mulan psl", 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "use compile sell", r"anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("beerware", "beer", r"beer ?ware licen[cs]e", 1.0),
    ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff", 1.0),
    ("fair", "this instrument", r"usage of the works is permitted provided that this instrument is retained with the works", 1.0),
    ("wtfpl", "want to", r"do what the fuck you want to(?: public licen[cs]e)?", 1.0),
    ("blessing", "is a blessing", r"in place of a legal notice here is a blessing", 1.0),
    ("cc0-1.0", "possible under law", r"to the extent possible under law(?: [^ ]+){1,12} waived all copyright and related or neighbou?ring rights", 1.0),
    ("cc0-1.0", "this deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd", 1.0),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa", 1.0),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc", 1.0),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd", 1.0),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa", 1.0),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by", 1.0),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark", 1.0),
    ("cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 0.8),
    ("cc-by-sa", "under the same license", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 0.95),
    ("cc-by-nd", "modified material", r"if you remix transform or build upon the material you may not distribute the modified material", 0.95),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes", 0.9),
    ("cc", "licensed rights", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons", 1.0),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl", 1.0),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by", 1.0),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl", 1.0),
    ("ogl", "open government", r"(?:contains public sector information licensed under the )?open government licen[cs]e(?: v ?[123] 0)?", 0.95),
    ("mit", "opensource org", r"opensource org licenses? mit", 0.95),
    ("isc", "opensource org", r"opensource org licenses? isc", 0.95),
    ("bsd-2-clause", "opensource org", r"opensource org licenses? bsd 2 clause", 0.95),
    ("bsd-3-clause", "opensource org", r"opensource org licenses? bsd 3 clause", 0.95),
    ("apache-2.0", "apache org", r"apache org licenses license 2 0", 1.0),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl", 0.9),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) lgpl", 0.9),
    ("agpl", "gnu org", r"gnu org (?:licenses|copyleft) agpl", 0.9),
    ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl", 0.9),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0", 0.95),
    ("epl", "eclipse org", r"eclipse org legal epl", 0.95),
    ("bsl-1.0", "boost org", r"boost org license 1 0 txt", 1.0),
    ("unlicense", "unlicense org", r"unlicense org", 0.8),
    ("ofl", "scripts sil", r"scripts sil org ofl", 1.0),
    ("apsl", "apple public", r"apple public source licen[cs]e", 0.95),
    ("cpal", "common public attribution", r"common public attribution licen[cs]e", 0.95),
    ("ecl", "educational community", r"educational community licen[cs]e", 0.95),
    ("efl", "eiffel forum", r"eiffel forum licen[cs]e", 0.95),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e", 0.95),
    ("rpsl", "realnetworks", r"realnetworks public source licen[cs]e", 0.95),
    ("spl", "sun public", r"sun public licen[cs]e", 0.95),
    ("lpl", "lucent public", r"lucent public licen[cs]e", 0.95),
    ("oldap", "openldap", r"openldap public licen[cs]e", 0.95),
    ("nosa", "nasa open", r"nasa open source agreement", 0.95),
    ("ngpl", "nethack", r"nethack general public licen[cs]e", 0.95),
    ("watcom", "watcom", r"(?:sybase )?open watcom public licen[cs]e", 0.95),
    ("wxwindows", "wxwindows", r"wxwindows library licen[cs]e", 0.95),
    ("nist", "institute of standards", r"developed (?:at|by employees of) the national institute of standards and technology", 0.75),
    ("openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?", 0.9),
    ("llama", "llama", r"llama [234](?: [1-9])? community licen[cs]e(?: agreement)?", 0.95),
    ("gemma", "gemma", r"gemma terms of use", 0.9),
    ("public-domain", "public domain", r"(?:dedicated to|released (?:in ?to|under)|placed in(?:to)?|is in) the public domain", 0.9),
    ("public-domain", "disclaims copyright", r"the authors? (?:hereby )?disclaims copyright to this source code", 0.95),
    ("public-domain", "united states government", r"(?:is|as) a work of the united states government", 0.8),
    ("proprietary", "proprietary and", r"proprietary and confidential", 0.8),
    ("proprietary", "proprietary information", r"(?:this software is )?(?:the )?confidential and proprietary information of", 0.9),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 1.0),
    ("proprietary", "any part of", r"no licen[cs]e to use copy modify or distribute any part of", 0.8),
    ("all-rights-reserved", "may be reproduced", r"no part of this (?:publication|book|document|work|site|article) may be reproduced(?: [^ ]+){0,12} in any form or by any means", 0.95),
    ("all-rights-reserved", "reproduced without", r"may not be (?:copied or )?reproduced without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)", 0.8),
    ("eula", "end user license", r"end user license agreement", 0.8),
    ("eula", "installing", r"by installing copying or otherwise using the software you agree to be bound by the terms", 0.95),
    ("noncommercial", "commercial use only", r"(?:for|licensed for) (?:personal (?:and )?)?non ?commercial use only", 0.8),
    ("research-only", "research purposes only", r"(?:may be used )?for (?:academic |non ?commercial )?research purposes only", 0.7),
    ("public-domain", "public domain", r"public domain", 0.5),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 0.6),
    ("other", "licen", r"(?:licensed|released) under (?:the )?(?:terms of )?(?:the )?[^ ]+(?: [^ ]+){0,3}? licen[cs]e", 0.4),
)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased, anything above U+007F counted in."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")


def _version(number: str) -> str:
    """A version in words: ``2 0``, ``2``, ``version 2 0``, ``v2`` or joined as in ``gplv2``."""
    major, minor = number.split(".")
    digits = rf"{major} {minor}" if minor != "0" else rf"{major} 0|{major}(?! [0-9])"
    return rf"(?: ?v(?:er(?:sion)?)? ?| )(?:{digits})(?= )(?: or (?:at your option )?(?:any )?later(?: version)?| only)?"


@cache
def _keywords() -> ahocorasick.Automaton:
    """All keywords, found in one pass over a line however many there are."""
    found = ahocorasick.Automaton()
    for _, keyword, _, _ in rules():
        found.add_word(keyword.decode("ascii"), keyword)
    found.make_automaton()
    return found


@cache
def rules() -> tuple[tuple[str, bytes, re.Pattern, float], ...]:
    """Label, keyword, expression, confidence, in order of priority: named versions, then passages, then bare names."""
    versioned, plain = [], []
    for form, confidence in FORMS:
        for label, keyword, name, versions in FAMILIES:
            for number in versions.split():
                versioned.append((f"{label}-{number}", keyword, form.replace("{n}", name + _version(number)), confidence))
            plain.append((label, keyword, form.replace("{n}", rf"{name}(?! licen[cs]e)"), confidence * 0.9))
    ordered = [*versioned, *((a, k, e, c) for a, k, e, c in PASSAGES if c > 0.6), *plain, *((a, k, e, c) for a, k, e, c in PASSAGES if c <= 0.6)]
    return tuple((label, keyword.encode(), re.compile(rf"(?<= )(?:{e})(?= )".encode()), c) for label, keyword, e, c in ordered)


def _places(line: bytes, phrase: bytes) -> Iterator[int]:
    at = line.find(phrase)
    while at >= 0:
        yield at
        at = line.find(phrase, at + 1)


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
    """Number of words; base places (word, label) in order; detections (label, first word, end word, confidence) by place."""
    words = [w for w in words_of(text) if w]
    line = b" " + b" ".join(words) + b" "
    keywords = {k for _, k in _keywords().iter(line.decode("latin-1"))}
    if not keywords:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))
    base = sorted((word(at), label) for phrase, label in BASE for at in _places(line, f" {phrase} ".encode()))
    kept: list[tuple[str, int, int, float]] = []
    starts = furthest = np.zeros(0, np.int64)  # of what is kept, by start: the start, and the furthest end up to there
    for label, keyword, expression, confidence in rules():
        hits = [m.span() for m in expression.finditer(line)] if keyword in keywords else ()
        if not hits:
            continue
        # hits of one rule never overlap, so they are held against those of the rules before it
        begin, end = np.array(hits, np.int64).T
        before = np.searchsorted(starts, begin, side="right")
        inside = (before > 0) & (np.concatenate(([0], furthest))[before] >= end)
        kept += [(label, x, y, confidence) for x, y in zip(begin[~inside].tolist(), end[~inside].tolist())]
        if not inside.all():
            spans = np.array([x[1:3] for x in kept], np.int64)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            starts, furthest = spans[:, 0], np.maximum.accumulate(spans[:, 1])
    found = sorted(((label, word(x) - 1, word(y), c) for label, x, y, c in kept), key=lambda x: (x[1], x[2], x[0]))
    return len(words), base, found


_FOUND = "doc_id long, n_words long, base array<struct<word: bigint, label: string>>, found array<struct<label: string, first: bigint, end: bigint, confidence: double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column("text")]
        columns = [
            batch.column("doc_id"),
            pa.array([n for n, _, _ in rows], pa.int64()),
            pa.array([[{"word": w, "label": x} for w, x in b] for _, b, _ in rows], place),
            pa.array([[dict(zip(("label", "first", "end", "confidence"), d)) for d in f] for _, _, f in rows], found),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "base", "found"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and the detections left after suppression, for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, _FOUND)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    sure = F.array_max(F.concat(F.transform("found", lambda x: x["confidence"]), F.transform("base", lambda x: F.lit(0.6).cast("double"))))
    return done.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "found.label")).alias("labels"),
        F.coalesce(sure, F.lit(0.0).cast("double")).alias("score"),
    )


QUERIES = {"op7_license_scans": op7_license_scans}
ORACLES: dict[str, str] = {}
