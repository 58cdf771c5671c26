"""Signature rules for license scans: hand-written regexes over the words of a text, in order, by keyword.

Words are in lower case with one space between them, and whatever else stood between them is gone, so `GPL-3.0` is
`gpl 3 0` and `v2` is one word. A rule is (label, priority, confidence, regex); every match of a rule holds the
keyword of its group. Rules of a group stand in order: at one place the first that matches counts.
"""

from __future__ import annotations

#: Confidence by what a rule sees: whole clauses and tags, statements, versions by name, bare names.
SURE, STATED, NAMED, BARE = 1.0, 0.95, 0.85, 0.7

#: Before a version number.
V = "(?: version| v|v|) ?"
#: After a version number.
LATER = "(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?"

GROUPS: tuple[tuple[str, tuple[tuple[str, int, float, str], ...]], ...] = (
    ("spdx license identifier", (
        ("gpl-3.0", 9, SURE, "spdx license identifier gpl 3 0 or later"),
        ("gpl-3.0", 9, SURE, "spdx license identifier gpl 3 0(?: only)?"),
        ("gpl-2.0", 9, SURE, "spdx license identifier gpl 2 0 or later"),
        ("gpl-2.0", 9, SURE, "spdx license identifier gpl 2 0(?: only)?"),
        ("gpl-1.0", 9, SURE, "spdx license identifier gpl 1 0(?: only| or later)?"),
        ("lgpl-3.0", 9, SURE, "spdx license identifier lgpl 3 0(?: only| or later)?"),
        ("lgpl-2.1", 9, SURE, "spdx license identifier lgpl 2 1(?: only| or later)?"),
        ("lgpl-2.0", 9, SURE, "spdx license identifier lgpl 2 0(?: only| or later)?"),
        ("agpl-3.0", 9, SURE, "spdx license identifier agpl 3 0(?: only| or later)?"),
        ("gfdl-1.3", 9, SURE, "spdx license identifier gfdl 1 3(?: only| or later)?"),
        ("gfdl-1.2", 9, SURE, "spdx license identifier gfdl 1 2(?: only| or later)?"),
        ("apache-2.0", 9, SURE, "spdx license identifier apache 2 0"),
        ("apache-1.1", 9, SURE, "spdx license identifier apache 1 1"),
        ("apache-1.0", 9, SURE, "spdx license identifier apache 1 0"),
        ("mit-0", 9, SURE, "spdx license identifier mit 0"),
        ("mit", 9, SURE, "spdx license identifier mit"),
        ("x11", 9, SURE, "spdx license identifier x11"),
        ("isc", 9, SURE, "spdx license identifier isc"),
        ("zlib", 9, SURE, "spdx license identifier zlib"),
        ("0bsd", 9, SURE, "spdx license identifier 0bsd"),
        ("bsd-2-clause", 9, SURE, "spdx license identifier bsd 2 clause(?: patent| views)?"),
        ("bsd-3-clause", 9, SURE, "spdx license identifier bsd 3 clause(?: clear| lbnl)?"),
        ("bsd-4-clause", 9, SURE, "spdx license identifier bsd 4 clause(?: uc)?"),
        ("boost-1.0", 9, SURE, "spdx license identifier bsl 1 0"),
        ("busl-1.1", 9, SURE, "spdx license identifier busl 1 1"),
        ("mpl-2.0", 9, SURE, "spdx license identifier mpl 2 0"),
        ("mpl-1.1", 9, SURE, "spdx license identifier mpl 1 1"),
        ("mpl-1.0", 9, SURE, "spdx license identifier mpl 1 0"),
        ("epl-2.0", 9, SURE, "spdx license identifier epl 2 0"),
        ("epl-1.0", 9, SURE, "spdx license identifier epl 1 0"),
        ("cddl-1.1", 9, SURE, "spdx license identifier cddl 1 1"),
        ("cddl-1.0", 9, SURE, "spdx license identifier cddl 1 0"),
        ("cpl-1.0", 9, SURE, "spdx license identifier cpl 1 0"),
        ("eupl-1.2", 9, SURE, "spdx license identifier eupl 1 2"),
        ("eupl-1.1", 9, SURE, "spdx license identifier eupl 1 1"),
        ("artistic-2.0", 9, SURE, "spdx license identifier artistic 2 0"),
        ("artistic-1.0", 9, SURE, "spdx license identifier artistic 1 0"),
        ("unlicense", 9, SURE, "spdx license identifier unlicense"),
        ("wtfpl", 9, SURE, "spdx license identifier wtfpl"),
        ("cc0-1.0", 9, SURE, "spdx license identifier cc0 1 0"),
        ("cc-by-4.0", 9, SURE, "spdx license identifier cc by 4 0"),
        ("cc-by-3.0", 9, SURE, "spdx license identifier cc by 3 0"),
        ("cc-by-sa-4.0", 9, SURE, "spdx license identifier cc by sa 4 0"),
        ("cc-by-sa-3.0", 9, SURE, "spdx license identifier cc by sa 3 0"),
        ("cc-by-nc-4.0", 9, SURE, "spdx license identifier cc by nc 4 0"),
        ("cc-by-nc-sa-4.0", 9, SURE, "spdx license identifier cc by nc sa 4 0"),
        ("cc-by-nc-nd-4.0", 9, SURE, "spdx license identifier cc by nc nd 4 0"),
        ("cc-by-nd-4.0", 9, SURE, "spdx license identifier cc by nd 4 0"),
        ("ofl-1.1", 9, SURE, "spdx license identifier ofl 1 1"),
        ("odbl-1.0", 9, SURE, "spdx license identifier odbl 1 0"),
        ("psf-2.0", 9, SURE, "spdx license identifier (?:psf|python) 2 0"),
        ("postgresql", 9, SURE, "spdx license identifier postgresql"),
        ("php-3.01", 9, SURE, "spdx license identifier php 3 01"),
        ("ruby", 9, SURE, "spdx license identifier ruby"),
        ("ncsa", 9, SURE, "spdx license identifier ncsa"),
        ("afl-3.0", 9, SURE, "spdx license identifier afl 3 0"),
        ("osl-3.0", 9, SURE, "spdx license identifier osl 3 0"),
        ("ms-pl", 9, SURE, "spdx license identifier ms pl"),
        ("ms-rl", 9, SURE, "spdx license identifier ms rl"),
        ("openssl", 9, SURE, "spdx license identifier openssl"),
        ("sspl-1.0", 9, SURE, "spdx license identifier sspl 1 0"),
        ("elastic-2.0", 9, SURE, "spdx license identifier elastic 2 0"),
        ("upl-1.0", 9, SURE, "spdx license identifier upl 1 0"),
        ("vim", 9, SURE, "spdx license identifier vim"),
        ("w3c", 9, SURE, "spdx license identifier w3c"),
        ("unicode", 9, SURE, "spdx license identifier unicode (?:dfs 2016|3 0|tou)"),
    )),
    ("general public license", (
        ("lgpl-3.0", 8, SURE, f"gnu lesser general public license(?: lgpl)? as published by the free software foundation (?:either )?version 3(?:{LATER})?"),
        ("lgpl-2.1", 8, SURE, f"gnu lesser general public license(?: lgpl)? as published by the free software foundation (?:either )?version 2 1(?:{LATER})?"),
        ("lgpl-2.0", 8, SURE, f"gnu (?:lesser|library) general public license(?: lgpl)? as published by the free software foundation (?:either )?version 2(?:{LATER})?"),
        ("agpl-3.0", 8, SURE, f"gnu affero general public license(?: agpl)? as published by the free software foundation (?:either )?version 3(?:{LATER})?"),
        ("gpl-3.0", 8, SURE, f"gnu general public license(?: gpl)? as published by the free software foundation (?:either )?version 3{LATER}"),
        ("gpl-2.0", 8, SURE, f"gnu general public license(?: gpl)? as published by the free software foundation (?:either )?version 2{LATER}"),
        ("gpl-1.0", 8, SURE, f"gnu general public license(?: gpl)? as published by the free software foundation (?:either )?version 1(?:{LATER})?"),
        ("gpl-3.0", 8, SURE, "gnu general public license(?: gpl)? as published by the free software foundation (?:only )?version 3(?: of the license)?(?: only)?"),
        ("gpl-2.0", 8, SURE, "gnu general public license(?: gpl)? as published by the free software foundation (?:only )?version 2(?: of the license)?(?: only)?"),
        ("lgpl-3.0", 6, STATED, f"gnu lesser general public license(?: lgpl)?{V}3(?: 0)?{LATER}"),
        ("lgpl-2.1", 6, STATED, f"gnu lesser general public license(?: lgpl)?{V}2 1{LATER}"),
        ("lgpl-2.0", 6, STATED, f"gnu (?:lesser|library) general public license(?: lgpl)?{V}2(?: 0)?{LATER}"),
        ("agpl-3.0", 6, STATED, f"gnu affero general public license(?: agpl)?{V}3(?: 0)?{LATER}"),
        ("gpl-3.0", 6, STATED, f"gnu general public license(?: gpl)?{V}3(?: 0)?{LATER}"),
        ("gpl-2.0", 6, STATED, f"gnu general public license(?: gpl)?{V}2(?: 0)?{LATER}"),
        ("lgpl-2.1", 4, NAMED, f"gnu lesser general public license(?: lgpl)?{V}2 1"),
        ("lgpl-3.0", 4, NAMED, f"gnu lesser general public license(?: lgpl)?{V}3(?: 0)?"),
        ("lgpl-2.0", 4, NAMED, f"gnu (?:lesser|library) general public license(?: lgpl)?{V}2(?: 0)?"),
        ("agpl-3.0", 4, NAMED, f"(?:gnu )?affero general public license(?: agpl)?{V}3(?: 0)?"),
        ("gpl-3.0", 4, NAMED, f"gnu general public license(?: gpl)?{V}3(?: 0)?"),
        ("gpl-2.0", 4, NAMED, f"gnu general public license(?: gpl)?{V}2(?: 0)?"),
        ("gpl-1.0", 4, NAMED, f"gnu general public license(?: gpl)?{V}1(?: 0)?"),
        ("gpl-3.0", 4, NAMED, "version 3 of the (?:gnu )?general public license"),
        ("gpl-2.0", 4, NAMED, "version 2 of the (?:gnu )?general public license"),
        ("lgpl-3.0", 4, NAMED, "version 3 of the (?:gnu )?lesser general public license"),
        ("lgpl-2.1", 4, NAMED, "version 2 1 of the (?:gnu )?lesser general public license"),
        ("agpl-3.0", 4, NAMED, "version 3 of the (?:gnu )?affero general public license"),
        ("gpl", 3, STATED, "(?:under|by|to) the terms (?:and conditions )?of the gnu general public license"),
        ("gpl", 3, STATED, "(?:licensed|released|distributed|available|published) under (?:the )?gnu general public license"),
        ("lgpl", 2, BARE, "gnu (?:lesser|library) general public license"),
        ("agpl", 2, BARE, "(?:gnu )?affero general public license"),
    )),
    ("gpl", (
        ("gpl-3.0", 6, STATED, f"gpl{V}3(?: 0)?{LATER}"),
        ("gpl-2.0", 6, STATED, f"gpl{V}2(?: 0)?{LATER}"),
        ("gpl-3.0", 4, NAMED, f"(?:gnu )?gpl{V}3(?: 0)?(?: only)?(?: licen[cs]e)?"),
        ("gpl-2.0", 4, NAMED, f"(?:gnu )?gpl{V}2(?: 0)?(?: only)?(?: licen[cs]e)?"),
        ("gpl-1.0", 4, NAMED, f"(?:gnu )?gpl{V}1(?: 0)?(?: licen[cs]e)?"),
        ("lgpl-2.1", 4, NAMED, f"(?:gnu )?lgpl{V}2 1(?: or later|{LATER})?"),
        ("lgpl-3.0", 4, NAMED, f"(?:gnu )?lgpl{V}3(?: 0)?(?: or later|{LATER})?"),
        ("lgpl-2.0", 4, NAMED, f"(?:gnu )?lgpl{V}2(?: 0)?(?: or later|{LATER})?"),
        ("agpl-3.0", 4, NAMED, f"(?:gnu )?agpl{V}3(?: 0)?(?: or later|{LATER})?"),
        ("gpl", 3, STATED, "(?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl"),
        ("lgpl", 3, STATED, "(?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?lgpl"),
        ("agpl", 3, STATED, "(?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?agpl"),
        ("gpl", 2, BARE, "(?:gnu )?gpl licen[cs]ed?"),
        ("lgpl", 2, BARE, "(?:gnu )?lgpl licen[cs]ed?"),
        ("agpl", 2, BARE, "(?:gnu )?agpl licen[cs]ed?"),
    )),
    ("free documentation license", (
        ("gfdl-1.3", 4, NAMED, f"gnu free documentation license{V}1 3(?:{LATER})?"),
        ("gfdl-1.2", 4, NAMED, f"gnu free documentation license{V}1 2(?:{LATER})?"),
        ("gfdl-1.1", 4, NAMED, f"gnu free documentation license{V}1 1(?:{LATER})?"),
        ("gfdl", 2, BARE, "gnu free documentation license"),
    )),
    ("free software foundation", (
        ("fsf-preserve", 6, SURE, "this file is free software the free software foundation gives unlimited permission to copy and or distribute it"),
        ("gpl", 5, STATED, "program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
        ("lgpl", 5, STATED, "library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    )),
    ("apache", (
        ("apache-2.0", 8, SURE, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
        ("apache-2.0", 8, SURE, "licensed to the apache software foundation asf under one or more contributor license agreements"),
        ("apache-1.1", 8, SURE, "this product includes software developed by the apache software foundation"),
        ("apache-1.0", 8, SURE, "this product includes software developed by the apache group"),
        ("apache-2.0", 6, STATED, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: software)?(?: license)?{V}2(?: 0)?"),
        ("apache-1.1", 6, STATED, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: software)?(?: license)?{V}1 1"),
        ("apache-2.0", 6, SURE, "(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
        ("apache-1.1", 6, SURE, "(?:https? )?(?:www )?apache org licenses license 1 1(?: txt| html)?"),
        ("apache-2.0", 4, NAMED, f"apache(?: software)? licen[cs]e{V}2(?: 0)?"),
        ("apache-1.1", 4, NAMED, f"apache(?: software)? licen[cs]e{V}1 1"),
        ("apache-1.0", 4, NAMED, f"apache(?: software)? licen[cs]e{V}1 0"),
        ("apache-2.0", 4, NAMED, "apache v?2(?: 0)?(?: licen[cs]ed?)?"),
        ("apache-1.1", 4, NAMED, "apache v?1 1(?: licen[cs]ed?)?"),
        ("apache", 2, BARE, "apache(?: style| software)? licensed"),
        ("apache", 2, BARE, "apache style licen[cs]e"),
    )),
    ("hereby granted", (
        ("mit", 8, SURE, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
        ("ofl-1.1", 8, SURE, "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell"),
        ("boost-1.0", 8, SURE, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        ("unicode", 8, SURE, "permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files and any associated documentation"),
        ("postgresql", 8, SURE, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
        ("0bsd", 8, SURE, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
        ("isc", 8, SURE, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?"),
        ("isc", 8, SURE, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
        ("hpnd", 8, SURE, "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
        ("ntp", 8, SURE, "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
        ("ncsa", 6, SURE, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
        ("mit", 5, STATED, "permission is hereby granted free of charge to any person obtaining a copy"),
    )),
    (" mit ", (
        ("mit-0", 6, STATED, "(?:licensed|released|distributed|available|published) under (?:the )?mit no attribution(?: licen[cs]e)?"),
        ("mit", 5, STATED, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:an? )?mit(?: x11)?(?: style)? licen[cs]e"),
        ("mit", 5, STATED, "(?:licensed|released|distributed|available) under mit"),
        ("mit", 4, STATED, "(?:under|subject to) the terms (?:and conditions )?of (?:the )?mit licen[cs]e"),
        ("mit", 3, NAMED, "(?:see|read|copy of) (?:the )?mit licen[cs]e"),
        ("mit", 3, SURE, "(?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php)?"),
        ("mit-0", 3, NAMED, "mit no attribution(?: licen[cs]e)?"),
        ("mit-0", 3, NAMED, "mit 0 licen[cs]ed?"),
        ("mit", 2, NAMED, "mit x11 licen[cs]ed?"),
        ("mit", 2, NAMED, "(?:the )?expat mit licen[cs]e"),
        ("mit", 1, BARE, "mit licen[cs]ed?"),
        ("mit", 1, BARE, "licen[cs]e mit"),
        ("mit", 1, BARE, "mit style licen[cs]e"),
    )),
    ("redistribution and use", (
        ("bsd-4-clause", 8, SURE, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met (?:[^ ]+ ){0,90}?all advertising materials mentioning features or use of this software must display"),
        ("bsd-3-clause", 8, SURE, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met (?:[^ ]+ ){0,120}?(?:neither the names? of|the names? of the authors? may not|names? of (?:its|the) contributors may not)"),
        ("bsd-2-clause", 7, SURE, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
        ("bsd", 6, STATED, "redistribution and use in source and binary forms(?: with or without modification are permitted)?"),
    )),
    ("bsd", (
        ("bsd-2-clause", 5, STATED, "(?:licensed|released|distributed|available|published) under (?:the |an? )?(?:simplified|freebsd|2 clause|two clause) bsd(?: style)?(?: licen[cs]e)?"),
        ("bsd-3-clause", 5, STATED, "(?:licensed|released|distributed|available|published) under (?:the |an? )?(?:new|modified|revised|3 clause|three clause) bsd(?: style)?(?: licen[cs]e)?"),
        ("bsd-4-clause", 5, STATED, "(?:licensed|released|distributed|available|published) under (?:the |an? )?(?:original|old|4 clause|four clause) bsd(?: style)?(?: licen[cs]e)?"),
        ("bsd", 5, STATED, "(?:licensed|released|distributed|available|published) under (?:the |an? )?bsd(?: style)?(?: licen[cs]e)?"),
        ("bsd-2-clause", 3, NAMED, "(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e"),
        ("bsd-3-clause", 3, NAMED, "(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e"),
        ("bsd-4-clause", 3, NAMED, "(?:original|old|4 clause|four clause) bsd licen[cs]e"),
        ("bsd-2-clause", 3, NAMED, "bsd 2 clause(?: simplified)?(?: licen[cs]e)?"),
        ("bsd-3-clause", 3, NAMED, "bsd 3 clause(?: new| revised)?(?: licen[cs]e)?"),
        ("bsd-4-clause", 3, NAMED, "bsd 4 clause(?: original)?(?: licen[cs]e)?"),
        ("0bsd", 3, NAMED, "(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?"),
        ("bsd", 1, BARE, "bsd(?: style| like)? licen[cs]ed?"),
        ("bsd", 1, SURE, "(?:https? )?(?:www )?opensource org licenses? bsd(?: license| [23] clause)?(?: php)?"),
    )),
    ("mozilla", (
        ("mpl-2.0", 8, SURE, "this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("mpl-1.1", 8, SURE, "the contents of this file are subject to the mozilla public license version 1 1"),
        ("mpl-1.0", 8, SURE, "the contents of this file are subject to the mozilla public license version 1 0"),
        ("mpl-2.0", 5, STATED, f"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mozilla public licen[cs]e{V}2(?: 0)?"),
        ("mpl-2.0", 4, NAMED, f"mozilla public licen[cs]e(?: mpl)?{V}2(?: 0)?"),
        ("mpl-1.1", 4, NAMED, f"mozilla public licen[cs]e(?: mpl)?{V}1 1"),
        ("mpl-1.0", 4, NAMED, f"mozilla public licen[cs]e(?: mpl)?{V}1 0"),
        ("mpl-2.0", 6, SURE, "(?:https? )?(?:www )?mozilla org mpl 2 0"),
        ("mpl", 2, BARE, "mozilla public licen[cs]e"),
    )),
    (" mpl", (
        ("mpl-2.0", 3, NAMED, "mpl v?2(?: 0)?(?: licen[cs]ed?)?"),
        ("mpl-1.1", 3, NAMED, "mpl v?1 1(?: licen[cs]ed?)?"),
        ("mpl-1.0", 3, NAMED, "mpl v?1 0(?: licen[cs]ed?)?"),
        ("mpl-2.0", 3, NAMED, "mplv2(?: 0)?"),
    )),
    ("eclipse", (
        ("epl-2.0", 8, SURE, "this program and the accompanying materials are made available under the terms of the eclipse public license v? ?2 0"),
        ("epl-1.0", 8, SURE, "this program and the accompanying materials are made available under the terms of the eclipse public license v? ?1 0"),
        ("edl-1.0", 6, STATED, f"eclipse distribution licen[cs]e{V}1 0"),
        ("epl-2.0", 4, NAMED, f"eclipse public licen[cs]e{V}2(?: 0)?"),
        ("epl-1.0", 4, NAMED, f"eclipse public licen[cs]e{V}1(?: 0)?"),
        ("epl-1.0", 6, SURE, "(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
        ("epl-2.0", 6, SURE, "(?:https? )?(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?"),
        ("epl", 2, BARE, "eclipse public licen[cs]e"),
    )),
    (" epl", (
        ("epl-2.0", 3, NAMED, "epl v?2(?: 0)?(?: licen[cs]ed?)?"),
        ("epl-1.0", 3, NAMED, "epl v?1(?: 0)?(?: licen[cs]ed?)?"),
    )),
    ("common", (
        ("cddl-1.1", 4, NAMED, f"common development and distribution licen[cs]e(?: cddl)?{V}1 1"),
        ("cddl-1.0", 4, NAMED, f"common development and distribution licen[cs]e(?: cddl)?{V}1(?: 0)?"),
        ("cddl", 2, BARE, "common development and distribution licen[cs]e"),
        ("cpl-1.0", 4, NAMED, f"common public licen[cs]e{V}1(?: 0)?"),
        ("cpl", 2, BARE, "common public licen[cs]e"),
        ("cpal-1.0", 4, NAMED, f"common public attribution licen[cs]e{V}1(?: 0)?"),
        ("commons-clause", 4, NAMED, f"commons clause(?: licen[cs]e)? condition{V}1(?: 0)?"),
        ("commons-clause", 5, SURE, "without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software under the commons clause"),
        ("cc-by-nc-nd-4.0", 6, NAMED, "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
        ("cc-by-nc-sa-4.0", 6, NAMED, "creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
        ("cc-by-nc-4.0", 5, NAMED, "creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
        ("cc-by-nd-4.0", 5, NAMED, "creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
        ("cc-by-sa-4.0", 5, NAMED, "creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
        ("cc-by-sa-3.0", 5, NAMED, "creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?"),
        ("cc-by-4.0", 4, NAMED, "creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
        ("cc-by-3.0", 4, NAMED, "creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?"),
        ("cc-by-2.0", 4, NAMED, "creative commons attribution 2 [05](?: generic)?(?: licen[cs]e)?"),
        ("cc0-1.0", 4, NAMED, "creative commons (?:cc0|zero)(?: v?1 0)?(?: universal)?(?: public domain dedication)?(?: licen[cs]e)?"),
        ("cc-by-nc-sa", 3, BARE, "creative commons attribution non ?commercial share ?alike"),
        ("cc-by-nc-nd", 3, BARE, "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
        ("cc-by-sa", 2, BARE, "creative commons attribution share ?alike"),
        ("cc-by-nc", 2, BARE, "creative commons attribution non ?commercial"),
        ("cc-by", 1, BARE, "creative commons attribution licen[cs]e"),
        ("cc", 1, BARE, "creative commons licen[cs]ed?"),
    )),
    ("cc by", (
        ("cc-by-nc-nd-4.0", 4, NAMED, "cc by nc nd(?: v?4 0| 4)(?: international)?"),
        ("cc-by-nc-sa-4.0", 4, NAMED, "cc by nc sa(?: v?4 0| 4)(?: international)?"),
        ("cc-by-nc-sa-3.0", 4, NAMED, "cc by nc sa v?3 0"),
        ("cc-by-nc-4.0", 4, NAMED, "cc by nc(?: v?4 0| 4)(?: international)?"),
        ("cc-by-nc-3.0", 4, NAMED, "cc by nc v?3 0"),
        ("cc-by-nd-4.0", 4, NAMED, "cc by nd(?: v?4 0| 4)(?: international)?"),
        ("cc-by-sa-4.0", 4, NAMED, "cc by sa(?: v?4 0| 4)(?: international)?"),
        ("cc-by-sa-3.0", 4, NAMED, "cc by sa v?3 0(?: unported)?"),
        ("cc-by-sa-2.0", 4, NAMED, "cc by sa v?2 [05]"),
        ("cc-by-4.0", 4, NAMED, "cc by(?: v?4 0| 4)(?: international)?"),
        ("cc-by-3.0", 4, NAMED, "cc by v?3 0(?: unported)?"),
        ("cc-by-2.0", 4, NAMED, "cc by v?2 [05]"),
        ("cc-by-nc-nd", 2, BARE, "cc by nc nd"),
        ("cc-by-nc-sa", 2, BARE, "cc by nc sa"),
        ("cc-by-sa", 2, BARE, "cc by sa"),
        ("cc-by-nc", 2, BARE, "cc by nc"),
        ("cc-by-nd", 2, BARE, "cc by nd"),
    )),
    ("creativecommons", (
        ("cc-by-nc-nd-4.0", 6, SURE, "creativecommons org licenses by nc nd 4 0"),
        ("cc-by-nc-sa-4.0", 6, SURE, "creativecommons org licenses by nc sa 4 0"),
        ("cc-by-nc-sa-3.0", 6, SURE, "creativecommons org licenses by nc sa 3 0"),
        ("cc-by-nc-4.0", 6, SURE, "creativecommons org licenses by nc 4 0"),
        ("cc-by-nd-4.0", 6, SURE, "creativecommons org licenses by nd 4 0"),
        ("cc-by-sa-4.0", 6, SURE, "creativecommons org licenses by sa 4 0"),
        ("cc-by-sa-3.0", 6, SURE, "creativecommons org licenses by sa 3 0"),
        ("cc-by-4.0", 6, SURE, "creativecommons org licenses by 4 0"),
        ("cc-by-3.0", 6, SURE, "creativecommons org licenses by 3 0"),
        ("cc-by-2.0", 6, SURE, "creativecommons org licenses by 2 [05]"),
        ("cc0-1.0", 6, SURE, "creativecommons org publicdomain zero 1 0"),
        ("public-domain", 6, SURE, "creativecommons org publicdomain mark 1 0"),
    )),
    ("cc0", (
        ("cc0-1.0", 4, NAMED, "cc0(?: v?1 0)?(?: universal)?(?: public domain dedication)?(?: licen[cs]e)?"),
    )),
    ("public domain", (
        ("unlicense", 8, SURE, "this is free and unencumbered software released into the public domain"),
        ("public-domain", 4, STATED, "(?:released|placed|put|dedicated) (?:in|into|to|by the authors? (?:in|into|to)) the public domain"),
        ("public-domain", 3, NAMED, "(?:is|are|be) (?:hereby )?in the public domain"),
        ("public-domain", 3, NAMED, "no copyright is claimed (?:[^ ]+ ){0,8}public domain"),
        ("public-domain", 2, BARE, "public domain dedication"),
        ("public-domain", 1, BARE, "in the public domain"),
    )),
    ("licen", (
        ("unlicense", 4, NAMED, "(?:the )?unlicense"),
        ("x11", 3, NAMED, "x11 licen[cs]ed?"),
        ("isc", 3, NAMED, "isc(?: style)? licen[cs]ed?"),
        ("zlib", 3, NAMED, "zlib(?: libpng)? licen[cs]ed?"),
        ("libpng", 3, NAMED, "(?:the )?libpng licen[cs]e"),
        ("boost-1.0", 5, STATED, f"distributed under the boost software license{V}1 0"),
        ("boost-1.0", 4, NAMED, f"boost software licen[cs]e(?:{V}1(?: 0)?)?"),
        ("eupl-1.2", 4, NAMED, f"european union public licen[cs]e(?: eupl)?{V}1 2"),
        ("eupl-1.1", 4, NAMED, f"european union public licen[cs]e(?: eupl)?{V}1 1"),
        ("eupl", 2, BARE, "european union public licen[cs]e"),
        ("artistic-2.0", 4, NAMED, f"artistic licen[cs]e{V}2(?: 0)?"),
        ("artistic-1.0", 4, NAMED, f"artistic licen[cs]e{V}1(?: 0)?"),
        ("artistic", 2, BARE, "(?:perl )?artistic licen[cs]e"),
        ("perl", 4, STATED, "licensed under the same terms as perl itself"),
        ("ofl-1.1", 4, NAMED, f"(?:sil )?open font licen[cs]e(?: ofl)?(?:{V}1 1)?"),
        ("odbl-1.0", 4, NAMED, f"open (?:data commons open )?database licen[cs]e(?: odbl)?(?:{V}1(?: 0)?)?"),
        ("odc-by-1.0", 4, NAMED, f"open data commons attribution licen[cs]e(?:{V}1(?: 0)?)?"),
        ("pddl-1.0", 4, NAMED, "open data commons public domain dedication and licen[cs]e"),
        ("psf-2.0", 4, NAMED, f"(?:psf licen[cs]e agreement|python software foundation licen[cs]e)(?:{V}2)?"),
        ("python-2.0", 4, NAMED, "python licen[cs]e 2 0"),
        ("postgresql", 3, NAMED, "postgresql licen[cs]e"),
        ("php-3.01", 4, NAMED, f"php licen[cs]e{V}3 01"),
        ("php-3.0", 4, NAMED, f"php licen[cs]e{V}3 0"),
        ("ruby", 3, NAMED, "ruby(?: s)? licen[cs]e"),
        ("ncsa", 3, NAMED, "(?:university of illinois )?ncsa open source licen[cs]e"),
        ("afl-3.0", 4, NAMED, f"academic free licen[cs]e(?: afl)?{V}3(?: 0)?"),
        ("afl-2.1", 4, NAMED, f"academic free licen[cs]e(?: afl)?{V}2 1"),
        ("osl-3.0", 4, NAMED, f"open software licen[cs]e(?: osl)?{V}3(?: 0)?"),
        ("osl-2.1", 4, NAMED, f"open software licen[cs]e(?: osl)?{V}2 1"),
        ("ms-pl", 4, NAMED, "microsoft public licen[cs]e(?: ms pl)?"),
        ("ms-rl", 4, NAMED, "microsoft reciprocal licen[cs]e(?: ms rl)?"),
        ("openssl", 4, NAMED, "openssl(?: and ssleay)? licen[cs]e"),
        ("ssleay", 3, NAMED, "(?:original )?ssleay licen[cs]e"),
        ("sspl-1.0", 4, NAMED, f"server side public licen[cs]e(?: sspl)?(?:{V}1(?: 0)?)?"),
        ("elastic-2.0", 4, NAMED, f"elastic licen[cs]e{V}2(?: 0)?"),
        ("elastic-1.0", 4, NAMED, f"elastic licen[cs]e{V}1(?: 0)?"),
        ("busl-1.1", 4, NAMED, f"business source licen[cs]e(?: bu?sl)?(?:{V}1 1)?"),
        ("upl-1.0", 4, NAMED, f"universal permissive licen[cs]e(?: upl)?(?:{V}1(?: 0)?)?"),
        ("w3c", 4, NAMED, "w3c software (?:notice and |and document notice and )?licen[cs]e"),
        ("unicode", 4, NAMED, "unicode (?:inc )?(?:data files and software )?licen[cs]e(?: agreement)?"),
        ("vim", 3, NAMED, "vim licen[cs]e"),
        ("curl", 3, NAMED, "curl licen[cs]e"),
        ("freetype", 3, NAMED, "freetype (?:project )?licen[cs]e"),
        ("imagemagick", 3, NAMED, "imagemagick licen[cs]e"),
        ("ijg", 3, NAMED, "independent jpeg group licen[cs]e"),
        ("json", 3, NAMED, "json licen[cs]e"),
        ("beerware", 3, NAMED, "beer ?ware licen[cs]e"),
        ("tcl", 3, NAMED, "tcl tk licen[cs]e"),
        ("zpl-2.1", 4, NAMED, f"zope public licen[cs]e(?: zpl)?{V}2 1"),
        ("zpl-2.0", 4, NAMED, f"zope public licen[cs]e(?: zpl)?{V}2 0"),
        ("cecill-2.1", 4, NAMED, f"cecill(?: free software)? licen[cs]e(?: agreement)?{V}2 1"),
        ("mulan-2.0", 4, NAMED, f"mulan (?:psl|permissive software) licen[cs]e{V}2(?: 0)?"),
        ("openrail", 4, NAMED, "(?:creativeml )?open ?rail(?: m| plus plus m)? licen[cs]e"),
        ("llama", 4, NAMED, "llama [0-9](?: [0-9])? community licen[cs]e(?: agreement)?"),
        ("wtfpl", 3, NAMED, "do what the fuck you want to public licen[cs]e"),
        ("proprietary", 3, STATED, "proprietary licen[cs]ed?(?: software)?"),
        ("commercial", 2, NAMED, "commercial licen[cs]e (?:is )?required"),
        ("dual", 2, NAMED, "(?:dual|multi) licen[cs]ed"),
    )),
    ("wtfpl", (
        ("wtfpl", 3, NAMED, "wtfpl(?: licen[cs]ed?)?"),
    )),
    ("as is", (
        ("zlib", 8, SURE, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
        ("curl", 7, SURE, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement of third party rights"),
    )),
    ("beer", (
        ("beerware", 7, SURE, "as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer(?: in return)?"),
    )),
    ("for good", (
        ("json", 7, SURE, "the software shall be used for good not evil"),
    )),
)

#: What of a text's own characters, in lower case, one must be found before it is cut into words: a part of a word, and a regex where
#: that part is common in other words.
GATES: tuple[tuple[str, str | None], ...] = (
    ("licen", None), ("gpl", None), ("apache", None), ("bsd", None), ("hereby", None), ("redistribution", None), ("spdx", None), ("wtfpl", None), ("mozilla", None),
    ("creativecommons", None), ("unencumbered", None),
    ("mit", r"under[\x00-\x2F\x3A-\x60\x7B-\x7F]+mit"),
    ("cc", r"(?<![0-9a-z\x80-\x{10FFFF}])cc(?:0|[\x00-\x2F\x3A-\x60\x7B-\x7F]+by)"),
    ("mpl", r"(?<![0-9a-z\x80-\x{10FFFF}])mpl[\x00-\x2F\x3A-\x60\x7B-\x7F]*v?[0-9]"),
    ("epl", r"(?<![0-9a-z\x80-\x{10FFFF}])epl[\x00-\x2F\x3A-\x60\x7B-\x7F]*v?[0-9]"),
    ("commons", r"(?:creative[\x00-\x2F\x3A-\x60\x7B-\x7F]+commons|commons[\x00-\x2F\x3A-\x60\x7B-\x7F]+clause)"),
    ("domain", r"public[\x00-\x2F\x3A-\x60\x7B-\x7F]+domain"), ("evil", r"good[\x00-\x2F\x3A-\x60\x7B-\x7F]+not[\x00-\x2F\x3A-\x60\x7B-\x7F]+evil"),
    ("attribution", r"mit[\x00-\x2F\x3A-\x60\x7B-\x7F]+no[\x00-\x2F\x3A-\x60\x7B-\x7F]+attribution"),
    ("beer", r"buy[\x00-\x2F\x3A-\x60\x7B-\x7F]+me[\x00-\x2F\x3A-\x60\x7B-\x7F]+a[\x00-\x2F\x3A-\x60\x7B-\x7F]+beer"),
    ("liable", r"as[\x00-\x2F\x3A-\x60\x7B-\x7F]+is"), ("noninfringement", None), ("foundation", r"free[\x00-\x2F\x3A-\x60\x7B-\x7F]+software"),
)
