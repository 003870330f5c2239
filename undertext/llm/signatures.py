"""Hand-written signatures of licenses: what their notices, grants, conditions and warranty clauses say.

Phrases are held against a text's lower-cased words with one space between them, so line breaks, comment marks and
punctuation do not matter. ~ stands for up to twelve words. Groups are not nested.
"""

from __future__ import annotations

GRANT, CLAUSE, NOTICE, TITLE, PLACE = (80, 0.9), (75, 0.8), (78, 0.9), (55, 0.6), (65, 0.7)

# Label, kind (priority and weight), phrase.
SIGNATURES = (
    ("mit", GRANT, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", CLAUSE, "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", PLACE, "opensource org licen[cs]es? mit"),
    ("mit-0", GRANT, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", CLAUSE, "except as contained in this notice the names? of~ shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("json", CLAUSE, "the software shall be used for good not evil"),
    ("ncsa", GRANT, "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("ncsa", TITLE, "university of illinois ncsa open source licen[cs]e"),
    ("bsd", GRANT, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", CLAUSE, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", CLAUSE, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("bsd", PLACE, "can be found in the licen[cs]e file~ bsd style"),
    ("bsd", NOTICE, "governed by a bsd style licen[cs]e"),
    ("bsd-2-clause", TITLE, "(?:simplified|freebsd) bsd licen[cs]e"),
    ("bsd-2-clause", PLACE, "opensource org licen[cs]es? bsd 2 clause"),
    ("bsd-3-clause", CLAUSE, "neither the names? of~ nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", TITLE, "(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd-3-clause", PLACE, "opensource org licen[cs]es? bsd 3 clause"),
    ("bsd-3-clause-clear", CLAUSE, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", CLAUSE, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("0bsd", GRANT, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("0bsd", TITLE, "(?:bsd zero clause|zero clause bsd) licen[cs]e"),
    ("isc", GRANT, "permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", GRANT, "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("postgresql", GRANT, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("zlib", GRANT, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", CLAUSE, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", CLAUSE, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", CLAUSE, "altered versions must be plainly marked as such and must not be misrepresented as being the original source"),
    ("boost-1.0", GRANT, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", PLACE, "boost org license 1 0 txt"),
    ("boost-1.0", TITLE, "boost software license version 1 0"),
    ("apache-2.0", NOTICE, "licensed under the apache license version 2 0 the license you may not use this (?:file|software) except in compliance with the license"),
    ("apache-2.0", GRANT, "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", CLAUSE, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", TITLE, "apache license version 2 0 january 2004"),
    ("apache-2.0", PLACE, "apache org licenses license 2 0"),
    ("apache", NOTICE, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", CLAUSE, "this product includes software developed by the apache software foundation"),
    ("apache-1.0", CLAUSE, "this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl", NOTICE, "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl", CLAUSE, "you should have received a copy of the gnu general public licen[cs]e along with"),
    ("gpl", CLAUSE, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e for more details"),
    ("gpl-1", NOTICE, "gnu general public licen[cs]e as published by the free software foundation(?: either)? version 1"),
    ("gpl-2", NOTICE, "gnu general public licen[cs]e as published by the free software foundation(?: either)? version 2"),
    ("gpl-2", NOTICE, "gnu general public licen[cs]e version 2(?: only)? as published by the free software foundation"),
    ("gpl-2", TITLE, "gnu general public licen[cs]e version 2 june 1991"),
    ("gpl-2", CLAUSE, "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license"),
    ("gpl-2", PLACE, "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3", NOTICE, "gnu general public licen[cs]e as published by the free software foundation(?: either)? version 3"),
    ("gpl-3", TITLE, "gnu general public licen[cs]e version 3 29 june 2007"),
    ("gpl-3", CLAUSE, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", PLACE, "gnu org licenses gpl 3 0"),
    ("gpl", PLACE, "gnu org (?:licenses|copyleft) gpl"),
    ("lgpl", NOTICE, "under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation"),
    ("lgpl", CLAUSE, "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with"),
    ("lgpl-2.0", NOTICE, "gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation(?: either)? version 2(?: of| or)"),
    ("lgpl-2.1", NOTICE, "gnu lesser general public licen[cs]e as published by the free software foundation(?: either)? version 2 1"),
    ("lgpl-2.1", TITLE, "gnu lesser general public licen[cs]e version 2 1 february 1999"),
    ("lgpl-3", NOTICE, "gnu lesser general public licen[cs]e as published by the free software foundation(?: either)? version 3"),
    ("lgpl-3", CLAUSE, "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", NOTICE, "under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("agpl", CLAUSE, "you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("agpl-3", NOTICE, "gnu affero general public licen[cs]e as published by the free software foundation(?: either)? version 3"),
    ("agpl-3", TITLE, "gnu affero general public licen[cs]e version 3 19 november 2007"),
    ("agpl-3", CLAUSE, "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", NOTICE, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2.0", NOTICE, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", CLAUSE, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", PLACE, "mozilla org mpl 2 0"),
    ("mpl-1.1", NOTICE, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", NOTICE, "the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-1.0", NOTICE, "made available under the terms of the eclipse public license v1 0"),
    ("epl-1.0", CLAUSE, "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl-2.0", NOTICE, "made available under the terms of the eclipse public license (?:v 2 0|v2 0|2 0)"),
    ("cddl", NOTICE, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", NOTICE, "licensed under the eupl version 1"),
    ("cpl-1.0", CLAUSE, "the accompanying program is provided under the terms of this common public license agreement"),
    ("ms-pl", TITLE, "microsoft public licen[cs]e ms pl"),
    ("ms-rl", TITLE, "microsoft reciprocal licen[cs]e ms rl"),
    ("artistic-1.0", CLAUSE, "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", CLAUSE, "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", NOTICE, "you can redistribute it and or modify it under the same terms as perl"),
    ("ruby", CLAUSE, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("unlicense", GRANT, "this is free and unencumbered software released into the public domain"),
    ("unlicense", CLAUSE, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", TITLE, "do what the fuck you want to public licen[cs]e"),
    ("beerware", GRANT, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("ofl-1.1", NOTICE, "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", GRANT, "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("odbl", NOTICE, "made available under the open database licen[cs]e"),
    ("odbl", PLACE, "opendatacommons org licenses odbl"),
    ("pddl", PLACE, "opendatacommons org licenses pddl"),
    ("odc-by", PLACE, "opendatacommons org licenses by"),
    ("cc0-1.0", CLAUSE, "to the extent possible under law~ waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", PLACE, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", NOTICE, "(?:released|placed|dedicated) (?:into|in|to) the public domain"),
    ("public-domain", PLACE, "creativecommons org publicdomain mark 1 0"),
    ("psf", GRANT, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", CLAUSE, "this product includes php software freely available from"),
    ("openssl", CLAUSE, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", CLAUSE, "this product includes cryptographic software written by eric young"),
    ("curl", TITLE, "copyright and permission notice copyright~ daniel stenberg"),
    ("wxwindows", TITLE, "wxwindows library licen[cs]e"),
    ("sspl-1.0", TITLE, "server side public licen[cs]e version 1"),
    ("busl-1.1", TITLE, "business source licen[cs]e 1 1"),
    *((f"cc-{k}-{v}", PLACE, f"creativecommons org licenses {k.replace('-', ' ')} {v.replace('.', ' ')}") for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    *((f"cc-{k}-{v}", NOTICE, f"{name} {v.replace('.', ' ')} (?:international|unported|generic|intergovernmental)") for k, name in (("by", "creative commons attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives")) for v in ("2.0", "2.5", "3.0", "4.0")),
)
