"""License scans: ordered signature rules behind keyword gates, DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with the label that each gives.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

L = r"licen[sc]e"
V = r"(?: version| v)? ?"

#: (label, keyword that every match holds, pattern). Names of licenses; patterns see lower-cased words joined by one space.
NAMES = (
    # Apache, MIT, ISC and the like
    ("apache-1.0", "apache", rf"apache(?: software)? {L}{V}1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? {L}{V}1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)? {L}{V}2(?: 0)?"),
    ("apache-2.0", "apache", r"apache(?: version| v)? ?2 0"),
    ("apache-2.0", "asl", r"asl ?2 0"),
    ("apache-2.0", "apache org", r"apache org licenses license 2 0"),
    ("apache", "apache", rf"apache(?: software)? {L}"),
    ("mit", "mit", rf"(?:the )?mit(?: expat)? {L}"),
    ("mit", "expat", rf"expat {L}"),
    ("mit", "opensource org", r"opensource org licenses mit"),
    ("mit-0", "mit", rf"mit (?:no attribution|0) {L}"),
    ("x11", "x11", rf"x11 {L}"),
    ("x11", "x consortium", rf"x consortium {L}"),
    ("isc", "isc", rf"isc {L}"),
    ("isc", "internet systems consortium", rf"internet systems consortium {L}"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {L}"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("icu", "icu", rf"icu {L}"),
    ("unicode", "unicode", rf"unicode(?: dfs)? {L}(?: agreement)?"),
    ("curl", "curl", rf"curl {L}"),
    ("ntp", "ntp", rf"ntp {L}"),
    ("beerware", "beer", r"beer ?ware(?: licen[sc]e)?"),
    ("fair", "fair", rf"fair {L}"),
    ("jsond", "json", rf"json {L}"),
    ("zpl-2.1", "zope", rf"zope public {L}{V}2 1"),
    ("zpl", "zope", rf"zope public {L}"),
    # BSD
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "zero clause", r"(?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?"),
    ("bsd-1-clause", "bsd", r"(?:bsd 1 clause|1 clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "freebsd", rf"freebsd(?: documentation)? {L}"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause-clear", "clear bsd", r"(?:the )?clear bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause-patent", "bsd", r"bsd(?: 2 clause)?(?: plus)? patent(?: licen[sc]e)?"),
    ("bsd", "bsd", rf"bsd(?: style| type)? {L}"),
    # GNU
    ("gpl-1.0", "gpl", r"gpl(?: version| v)? ?1(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "general public", rf"(?:gnu )?general public {L}(?: gpl)?{V}1(?: 0)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: 0)?(?: only)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: only)?"),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public {L}(?: gpl)?{V}2(?: 0)?"),
    ("gpl-2.0-or-later", "gplv2", r"(?:gnu )?gplv2(?: 0)?(?: or (?:any )?(?:later|newer|above))(?: version)?"),
    ("gpl-2.0-or-later", "gpl", r"(?:gnu )?gpl(?: version| v)? ?2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer|above)(?: version)?"),
    ("gpl-2.0-or-later", "general public", rf"(?:gnu )?general public {L}(?: gpl)?{V}2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
    ("gpl-2.0-or-later", "version 2 of the", r"either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: 0)?(?: only)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: only)?"),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public {L}(?: gpl)?{V}3(?: 0)?"),
    ("gpl-3.0-or-later", "gplv3", r"(?:gnu )?gplv3(?: 0)? or (?:any )?(?:later|newer|above)(?: version)?"),
    ("gpl-3.0-or-later", "gpl", r"(?:gnu )?gpl(?: version| v)? ?3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer|above)(?: version)?"),
    ("gpl-3.0-or-later", "general public", rf"(?:gnu )?general public {L}(?: gpl)?{V}3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
    ("gpl-3.0-or-later", "version 3 of the", r"either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-classpath", "classpath", r"(?:gpl(?:v2| 2 0)? )?with (?:the )?classpath exception"),
    ("gpl-gcc-exception", "gcc runtime", r"gcc runtime library exception"),
    ("lgpl-2.0", "library general", rf"(?:gnu )?library general public {L}(?:{V}2(?: 0)?)?"),
    ("lgpl-2.0", "lgplv2", r"(?:gnu )?lgplv2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version| v)? ?2 1(?: only)?"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2 1(?: only)?"),
    ("lgpl-2.1", "lesser general", rf"(?:gnu )?lesser general public {L}(?: lgpl)?{V}2 1"),
    ("lgpl-2.1-or-later", "lgpl", r"(?:gnu )?lgpl(?: version| v)? ?2 1 or (?:any )?(?:later|newer)(?: version)?"),
    ("lgpl-2.1-or-later", "lgplv2", r"(?:gnu )?lgplv2 1 or (?:any )?(?:later|newer)(?: version)?"),
    ("lgpl-2.1-or-later", "lesser general", rf"(?:gnu )?lesser general public {L}(?: lgpl)?{V}2 1 or (?:any )?later(?: version)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?(?: only)?"),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?(?: only)?"),
    ("lgpl-3.0", "lesser general", rf"(?:gnu )?lesser general public {L}(?: lgpl)?{V}3(?: 0)?"),
    ("lgpl-3.0-or-later", "lgpl", r"(?:gnu )?lgpl(?: version| v)? ?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?"),
    ("lgpl", "lesser general", rf"(?:gnu )?lesser general public {L}"),
    ("agpl-1.0", "affero", rf"affero general public {L}{V}1(?: 0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: version| v)? ?3(?: 0)?(?: only)?"),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3(?: 0)?(?: only)?"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public {L}(?: agpl)?{V}3(?: 0)?"),
    ("agpl-3.0-or-later", "agpl", r"(?:gnu )?agpl(?: version| v)? ?3(?: 0)? or (?:any )?later(?: version)?"),
    ("agpl-3.0-or-later", "affero", rf"(?:gnu )?affero general public {L}(?: agpl)?{V}3(?: 0)? or (?:any )?later(?: version)?"),
    ("agpl", "affero", rf"(?:gnu )?affero general public {L}"),
    ("gfdl-1.1", "gfdl", r"gfdl(?: version| v)? ?1 1"),
    ("gfdl-1.2", "documentation", rf"(?:gnu )?free documentation {L}{V}1 2"),
    ("gfdl-1.3", "documentation", rf"(?:gnu )?free documentation {L}{V}1 3"),
    ("gfdl-1.3", "gfdl", r"gfdl(?: version| v)? ?1 3"),
    ("gfdl", "documentation", rf"gnu free documentation {L}"),
    ("gnu-all-permissive", "all permissive", rf"gnu all permissive {L}"),
    # Weak copyleft
    ("mpl-1.0", "mozilla", rf"mozilla public {L}{V}1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public {L}{V}1 1"),
    ("mpl-1.1", "mpl", r"mpl(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public {L}{V}2(?: 0)?"),
    ("mpl-2.0", "mpl", r"mpl(?: version| v)? ?2 0"),
    ("mpl-2.0", "mplv2", r"mplv2(?: 0)?"),
    ("mpl", "mozilla", rf"mozilla public {L}"),
    ("npl", "netscape", rf"netscape public {L}"),
    ("epl-1.0", "eclipse", rf"eclipse public {L}{V}1(?: 0)?"),
    ("epl-1.0", "epl", r"epl(?: version| v)? ?1 0"),
    ("epl-2.0", "eclipse", rf"eclipse public {L}{V}2(?: 0)?"),
    ("epl-2.0", "epl", r"epl(?: version| v)? ?2 0"),
    ("epl", "eclipse", rf"eclipse public {L}"),
    ("edl-1.0", "eclipse", rf"eclipse distribution {L}(?:{V}1 0)?"),
    ("cpl-1.0", "common public", rf"common public {L}(?:{V}1 0)?"),
    ("cpal-1.0", "common public attribution", rf"common public attribution {L}(?:{V}1 0)?"),
    ("ipl-1.0", "ibm public", rf"ibm public {L}(?:{V}1 0)?"),
    ("cddl-1.0", "common development", rf"common development and distribution {L}(?: cddl)?(?:{V}1 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: version| v)? ?1 0"),
    ("cddl-1.1", "cddl", r"cddl(?: version| v)? ?1 1"),
    ("eupl-1.1", "european union", rf"european union public {L}{V}1 1"),
    ("eupl-1.2", "european union", rf"european union public {L}(?:{V}1 2)?"),
    ("eupl-1.2", "eupl", r"eupl(?: version| v)? ?1 2"),
    ("cecill-2.1", "cecill", rf"cecill(?: free software {L})?(?:(?: agreement)?{V}2 1)?"),
    ("cecill-b", "cecill", rf"cecill b(?: {L})?"),
    ("cecill-c", "cecill", rf"cecill c(?: {L})?"),
    ("osl-3.0", "open software", rf"open software {L}(?:{V}3 0)?"),
    ("afl-3.0", "academic free", rf"academic free {L}(?:{V}[23] [01])?"),
    ("ecl-2.0", "educational community", rf"educational community {L}(?:{V}2 0)?"),
    ("ms-pl", "microsoft public", rf"microsoft public {L}"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", rf"microsoft reciprocal {L}"),
    ("artistic-1.0", "artistic", rf"artistic {L}{V}1(?: 0)?"),
    ("artistic-2.0", "artistic", rf"artistic {L}{V}2(?: 0)?"),
    ("artistic", "artistic", rf"(?:perl )?artistic {L}"),
    ("clarified-artistic", "clarified artistic", rf"clarified artistic {L}"),
    ("perl", "terms as perl", r"(?:under )?the same terms as perl(?: itself)?"),
    ("ruby", "ruby", rf"ruby s? ?{L}"),
    ("php-3.01", "php", rf"php {L}(?:{V}3 0?1)?"),
    ("python-2.0", "python", rf"python {L}(?:{V}2 0)?"),
    ("psf-2.0", "python software", rf"python software foundation {L}(?:{V}2)?"),
    ("psf-2.0", "psf", rf"psf {L}"),
    ("tcl", "tcl", rf"tcl(?: tk)? {L}"),
    ("lppl-1.3c", "latex project", rf"latex project public {L}(?:{V}1 3c?)?"),
    ("lppl-1.3c", "lppl", r"lppl(?: version| v)? ?1 3c?"),
    ("sleepycat", "sleepycat", rf"sleepycat(?: public)? {L}"),
    ("oldap-2.8", "openldap", rf"openldap public {L}(?:{V}2 8)?"),
    ("openssl", "openssl", rf"openssl {L}"),
    ("vim", "vim", rf"vim {L}"),
    ("w3c", "w3c", rf"w3c(?: software)?(?: notice)?(?: and)?(?: document)? {L}"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {L}"),
    ("libpng", "libpng", rf"libpng {L}"),
    ("libtiff", "libtiff", rf"libtiff {L}"),
    ("ijg", "jpeg group", rf"independent jpeg group(?: s)? {L}"),
    ("bzip2", "bzip2", rf"bzip2 {L}"),
    ("ftl", "freetype", rf"freetype(?: project)? {L}"),
    ("boost-1.0", "boost", rf"boost(?: software)? {L}(?:{V}1 0)?"),
    ("boost-1.0", "bsl 1 0", r"bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "do what the", rf"do what the fuck you want to public {L}"),
    ("postgresql", "postgresql", rf"postgresql {L}"),
    ("blueoak-1.0.0", "blue oak", rf"blue oak model {L}(?:{V}1 0 0)?"),
    ("upl-1.0", "universal permissive", rf"universal permissive {L}(?:{V}1 0)?"),
    ("mulan-2.0", "mulan", rf"mulan psl(?:{V}2)?"),
    ("sissl", "sun industry", rf"sun industry standards source {L}"),
    ("apsl-2.0", "apple public", rf"apple public source {L}(?:{V}2(?: 0)?)?"),
    ("nasa-1.3", "nasa open", rf"nasa open source agreement(?:{V}1 3)?"),
    ("qpl-1.0", "q public", rf"q public {L}(?:{V}1 0)?"),
    ("rpl-1.5", "reciprocal public", rf"reciprocal public {L}(?:{V}1 5)?"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font {L}(?:{V}1 [01])?"),
    ("ofl-1.1", "ofl", r"ofl(?: version| v)? ?1 1"),
    ("ubuntu-font", "ubuntu font", rf"ubuntu font {L}(?:{V}1 0)?"),
    ("bitstream-vera", "bitstream vera", rf"bitstream vera(?: fonts?)? {L}"),
    # Source available
    ("sspl-1.0", "server side public", rf"server side public {L}(?:{V}1)?"),
    ("sspl-1.0", "sspl", r"sspl(?: version| v)?(?: ?1(?: 0)?)?"),
    ("elastic-2.0", "elastic", rf"elastic {L}(?:{V}2 0)?"),
    ("busl-1.1", "business source", rf"business source {L}(?:{V}1 1)?"),
    ("busl-1.1", "busl", r"busl 1 1"),
    ("commons-clause", "commons clause", rf"commons clause(?: {L} condition)?"),
    ("polyform-noncommercial", "polyform", rf"polyform non ?commercial {L}"),
    ("polyform", "polyform", rf"polyform(?: [a-z]+)+? {L}"),
    ("confluent-community", "confluent community", rf"confluent community {L}"),
    ("redis-source-available", "redis source", rf"redis source available {L}"),
    ("timescale", "timescale", rf"timescale {L}"),
    # Models and data
    ("openrail-m", "rail", r"(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("llama", "llama", rf"llama [0-9](?: [0-9])? community {L}(?: agreement)?"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("odbl-1.0", "open database", rf"open database {L}(?:{V}1 0)?"),
    ("odbl-1.0", "odbl", r"odbl(?: version| v)?(?: ?1 0)?"),
    ("odc-by-1.0", "open data commons", rf"open data commons attribution {L}(?:{V}1 0)?"),
    ("odc-by-1.0", "odc by", r"odc by(?: 1 0)?"),
    ("pddl-1.0", "public domain dedication", rf"(?:open data commons )?public domain dedication(?: and {L})?"),
    ("cdla-permissive", "community data", rf"community data {L} agreement permissive(?:{V}[12] 0)?"),
    ("cdla-sharing", "community data", rf"community data {L} agreement sharing(?:{V}1 0)?"),
    ("ogl-uk-3.0", "open government", rf"open government {L}(?:{V}3 0)?"),
    ("etalab-2.0", "etalab", rf"etalab(?: open)? {L}?(?:{V}2 0)?"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?"),
    # Creative Commons
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: v)?(?: ?1 0)?(?: universal)?"),
    ("cc-pdm", "public domain mark", r"public domain mark(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by-1.0", "cc by", r"cc by 1 0"),
    ("cc-by-2.0", "cc by", r"cc by 2 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc", "creativecommons org", r"creativecommons org licenses by(?: nc| nd| sa)*(?: [1-4] 0)?"),
    ("cc", "creative commons", rf"creative commons {L}"),
)

#: Names that say nothing of a license by themselves, only behind words that grant one or name an identifier. (label, pattern)
SHORT = (
    ("mit", r"mit"), ("mit", r"expat"), ("isc", r"isc"), ("x11", r"x11"), ("zlib", r"zlib"), ("ncsa", r"ncsa"), ("apache", r"apache"), ("bsd", r"bsd"), ("curl", r"curl"),
    ("gpl", r"gnu gpl"), ("gpl", r"gpl"), ("lgpl", r"(?:gnu )?lgpl"), ("agpl", r"(?:gnu )?agpl"), ("mpl", r"mpl"), ("epl", r"epl"), ("cddl", r"cddl"), ("eupl", r"eupl"), ("boost-1.0", r"bsl"), ("psf-2.0", r"psf 2 0"),
    ("python-2.0", r"python 2 0"), ("artistic-1.0", r"artistic 1 0"), ("artistic-2.0", r"artistic 2 0"), ("ms-rl", r"ms rl"), ("upl-1.0", r"upl 1 0"), ("osl-3.0", r"osl 3 0"), ("afl-3.0", r"afl 3 0"),
    ("ecl-2.0", r"ecl 2 0"), ("elastic-2.0", r"elastic 2 0"), ("postgresql", r"postgresql"), ("openssl", r"openssl"), ("php-3.01", r"php 3 0?1"), ("ruby", r"ruby"), ("vim", r"vim"), ("wtfpl", r"wtfpl"), ("apache-1.1", r"apache 1 1"),
    ("cc-by", r"cc by"), ("pddl-1.0", r"pddl(?: 1 0)?"), ("blueoak-1.0.0", r"blueoak 1 0 0"), ("zpl-2.1", r"zpl 2 1"), ("cpl-1.0", r"cpl 1 0"), ("ofl-1.1", r"ofl"), ("proprietary", r"a proprietary licen[sc]e"),
)

#: How a text speaks of a license, strongest first: (confidence, words before a name).
FRAMES = (
    (1.0, r"(?:is |are )?(?:licen[sc]ed|released|distributed|published|available|made available|provided) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"),
    (0.95, r"spdx licen[sc]e identifier "),
    (0.9, r"(?:subject to|governed by|in accordance with|compliance with|see|read|covered by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"),
)
BARE = 0.6

#: (label, keyword, confidence, pattern): sentences of license texts and notices.
OTHERS = (
    ("mit", "permission is hereby", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", 0.8, r"shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", 0.95, r"permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", "permission to use", 0.9, r"permission to use copy modify and distribute this software and its documentation"),
    ("bsd", "redistribution and use", 0.95, r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistributions of source", 0.8, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", 0.8, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", 0.8, r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", 0.9, r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "except in compliance", 0.9, r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "on an as is", 0.7, r"distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "free software", 0.9, r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", "free software", 0.9, r"this library is free software you can redistribute it and or modify it"),
    ("gpl", "in the hope that", 0.7, r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy of the gnu", 0.8, r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", "received a copy of the gnu", 0.8, r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "received a copy of the gnu", 0.8, r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("mpl-2.0", "this source code form", 0.95, r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("epl", "accompanying materials", 0.8, r"this program and the accompanying materials are made available under the terms"),
    ("zlib", "express or implied", 0.8, r"this software is provided as is without any express or implied warranty in no event"),
    ("zlib", "altered source", 0.9, r"altered source versions must be plainly marked as such"),
    ("boost-1.0", "boost org", 0.9, r"boost org license 1 0 txt"),
    ("unlicense", "unencumbered", 0.95, r"free and unencumbered software released into the public domain"),
    ("wtfpl", "copy and distribute verbatim", 0.4, r"everyone is permitted to copy and distribute verbatim"),
    ("ofl-1.1", "reserved font", 0.8, r"reserved font names?"),
    ("ms-pl", "contributor grants", 0.6, r"each contributor grants you a non exclusive worldwide royalty free"),
    ("cc-by", "redistribute the material", 0.5, r"share copy and redistribute the material in any medium or format"),
    ("reserved", "reserved", 0.9, r"(?:all|some|no) rights (?:are )?reserved"),
    ("reserved", "derechos reservados", 0.9, r"todos los derechos reservados"),
    ("reserved", "droits", 0.9, r"tous droits réservés"),
    ("reserved", "rechte vorbehalten", 0.9, r"alle rechte vorbehalten"),
    ("copyright", "copyright", 0.9, r"copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?"),
    ("copyright", "copyright", 0.5, r"copyright notice"),
    ("copyright", "copyright", 0.5, r"copyright holders?"),
    ("public-domain", "public domain", 0.9, r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", 0.6, r"public domain"),
    ("warranty", "warrant", 0.5, r"without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    ("warranty", "merchantability", 0.5, r"merchantability(?: or|  and)? fitness for a particular purpose"),
    ("warranty", "as is", 0.5, r"provided (?:by the copyright holders and contributors )?as is"),
    ("liability", "in no event shall", 0.4, r"in no event shall (?:the )?(?:authors?|copyright (?:holders?|owners?)|contributors?)"),
    ("proprietary", "proprietary", 0.6, r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", 0.7, r"unauthorized (?:copying|reproduction|distribution)(?: of this (?:file|document|material))?"),
    ("proprietary", "trade secret", 0.5, r"trade secrets? of"),
    ("eula", "end user", 0.7, rf"end user {L} agreement"),
    ("no-license", "licen", 0.5, r"no licen[sc]e (?:is )?(?:granted|given)"),
    ("no-reproduction", "may be reproduced", 0.8, r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("non-commercial", "commercial", 0.6, r"(?:for )?non ?commercial use only"),
    ("fair-use", "fair use", 0.4, r"fair use"),
)

#: Words of which a text that passes holds one, or else a part of GATE_PAIRS and a match of its pattern; a text without either matches no rule.
#: The text may have any signs between words, so the gate looks at single words.
GATE = (
    "licen", "copyright", "reserved", "reservados", "réservés", "vorbehalten", "cc0", "public", "gpl", "gfdl", "cddl", "eupl", "lppl", "sspl", "odbl", "pddl", "warrant", "merchantab", "permission", "permitted", "redistribut",
    "proprietary", "unauthorized", "creativecommons", "wtfpl", "bsd", "beer", "cecill", "polyform", "gemma", "mulan", "spdx", "altered", "attribution", "reproduced", "noncommercial", "classpath", "etalab", "datenlizenz",
)
_S = "[^a-z0-9]+"
_NUMBERED = r"(?<![a-z0-9])(?:apache|asl|mpl|epl|ofl|bsl|busl|odc|ms|cc|creative|llama)(?:v?[0-9]|[^a-z0-9]+(?:version|v|commons|by|pl|[0-9]))"
#: (part of a word, pattern of what stands there).
GATE_PAIRS = (
    *((w, _NUMBERED) for w in ("apache", "asl", "mpl", "epl", "ofl", "bsl", "busl", "odc", "llama")),
    ("ms", r"(?<![a-z0-9])ms[^a-z0-9]+(?:pl|rl)(?![a-z0-9])"), ("cc", r"(?<![a-z0-9])cc[^a-z0-9]+by(?![a-z0-9])"), ("creative", rf"creative{_S}commons"),
    *((w, rf"{w}{_S}(?:under|by|as){_S}") for w in ("released", "distributed", "available", "published", "provided")),
    ("fair", rf"fair{_S}use"), ("substantial", rf"substantial{_S}portions"), ("software", rf"(?:free{_S}software|software{_S}is)"), ("rail", r"open[^a-z0-9]*rail"), ("same", rf"same{_S}terms"), ("clause", rf"commons{_S}clause"),
    ("event", rf"no{_S}event"), ("commercial", rf"non{_S}commercial"), ("endorse", rf"endorse{_S}or"), ("advertising", rf"advertising{_S}materials"), ("runtime", rf"runtime{_S}library"), ("source", rf"open{_S}source"), ("secret", rf"trade{_S}secret"),
    ("share", rf"share{_S}copy"), ("hope", rf"the{_S}hope"), ("accompanying", rf"accompanying{_S}materials"), ("contributor", rf"contributor{_S}grants"), ("font", rf"reserved{_S}font"),
)


def groups() -> dict[str, list[tuple[str, list[tuple[int, str, float, str]]]]]:
    """By keyword: patterns that a text must match for its rules to, and those rules (priority, label, confidence, pattern), the lowest priority the strongest."""
    made = [(sure, label, key, name, f"{before}{name}") for sure, before in (*FRAMES, (BARE, "")) for label, key, name in NAMES]
    # A short name stands behind other words, so a space goes before what it begins with.
    made += [(sure, label, " " + re.match(r"[a-z ]*", name.removeprefix("(?:gnu )?")).group().rstrip(), name, f"{before}{name}") for sure, before in FRAMES[:2] for label, name in SHORT]
    made += [(sure, label, key, pattern, pattern) for label, key, sure, pattern in OTHERS]
    made.sort(key=lambda r: -r[0])
    whole = lambda p: rf"(?<![^ ]){p}(?![^ ])"
    out: dict[str, dict[str, list]] = {}
    for k, (sure, label, key, name, pattern) in enumerate(made):
        out.setdefault(key, {}).setdefault(whole(name), []).append((k, label, sure, whole(pattern)))
    return {key: list(names.items()) for key, names in out.items()}


def rules() -> list[tuple[int, str, str, float, str]]:
    """(priority, label, keyword, confidence, pattern) of all rules, the first the strongest."""
    return sorted((k, label, key, sure, pattern) for key, names in groups().items() for _, own in names for k, label, sure, pattern in own)


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_gate(text: Column) -> Column:
    """Whether a lower-cased text passes the gate."""
    gate = F.lit(False)
    for word, pattern in reversed(GATE_PAIRS):
        gate = (F.contains(text, F.lit(word)) & text.rlike(pattern)) | gate
    for word in reversed(GATE):
        gate = F.contains(text, F.lit(word)) | gate
    return gate


#: Elements that one fold appends to its list; longer lists are folded in pieces of so many, so the work stays in proportion to their length.
PIECE = 256


def _pieces(array: str, name: str, body: str) -> str:
    """body over name: the pieces of an array, in order."""
    return f"element_at(transform(array(if(size({array}) = 0, cast(array() as array<int>), sequence(0, (size({array}) - 1) div {PIECE}))), ks -> element_at(transform(array(transform(ks, k -> slice({array}, k * {PIECE} + 1, {PIECE}))), {name} -> {body}), 1)), 1)"


def _running(pieces: str, start: str, step: str) -> str:
    """For each piece what step has made of start by then: an array; step folds (a, x)."""
    return f"aggregate({pieces}, named_struct('at', {start}, 'out', cast(array() as array<int>)), (acc, p) -> named_struct('at', aggregate(p, acc.at, (a, x) -> {step}), 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections): one per document.

    Every text is lower-cased in A-Z and cut into words. Texts that pass the gate are
    searched for the base phrases, on words, and by the rules whose keyword they hold, on
    the words joined by spaces. A detection (rule, start, end) that lies within another
    is dropped; of equal intervals the rule of the higher priority stays. labels are
    those of the base phrases and of what stays, score the surest confidence (0 to 1).

    All of it is one projection of a document: nothing is shuffled. A null or empty text counts as
    empty: no words, no places (null first and last), empty labels, score 0. A very long text is scanned whole, in time in proportion to its
    length. Rows with null or repeated ids and repeated rows give their own rows; an empty table gives none. Other columns are not read.
    """
    rule = lambda p, label, sure, pattern: f"named_struct('p', {p}, 'label', {_literal(label)}, 'sure', cast({sure} as double), 're', {_literal(pattern)})"
    name = lambda pattern, own: f"named_struct('re', {_literal(pattern)}, 'rules', array({', '.join(rule(*r) for r in own)}))"
    table = "array(" + ", ".join(f"named_struct('key', {_literal(k)}, 'names', array({', '.join(name(*n) for n in names)}))" for k, names in groups().items()) + ")"
    raw = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("_t"))
    # The same words, whether counted before A-Z are lower-cased or after.
    df = df.withColumn("n_words", F.regexp_count("_t", F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))).cast("long"))
    lowered = F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("w", F.when(keyword_gate(F.lower("_t")), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)))).drop("_t")
    starts = []
    for phrase, label in BASE:
        parts = phrase.split()
        same = " and ".join(f"w[i + {k}] = {_literal(x)}" for k, x in enumerate(parts))
        starts.append((label, f"if(size(w) >= {len(parts)}, filter(sequence(0, size(w) - {len(parts)}), i -> {same}), array())"))
    df = df.withColumn("base", F.expr("array(" + ", ".join(f"named_struct('label', '{a}', 'at', {e})" for a, e in starts) + ")"))
    df = df.withColumn("places", F.expr("if(w is null, array(), flatten(transform(base, b -> b.at)))"))
    df = df.withColumn("norm", F.expr("array_join(w, ' ')"))
    # Of each rule whose keyword the text holds: its matches, and where they start, from the pieces between them.
    spans = """
        aggregate(p, named_struct('at', s, 'out', cast(array() as array<struct<s:int, e:int>>)),
            (acc, x) -> named_struct(
                'at', acc.at + length(x.piece) + coalesce(length(x.hit), 0),
                'out', if(x.hit is null, acc.out, concat(acc.out, array(named_struct('s', acc.at + length(x.piece), 'e', acc.at + length(x.piece) + length(x.hit)))))),
            acc -> acc.out)
    """
    starts_at = _running("ps", "0", "a + length(x.piece) + coalesce(length(x.hit), 0)")
    matched = f"element_at(transform(array(zip_with(split(norm, r.re, -1), regexp_extract_all(norm, r.re, 0), (a, b) -> named_struct('piece', a, 'hit', b))), z -> {_pieces('z', 'ps', f'flatten(zip_with(ps, {starts_at}, (p, s) -> {spans}))')}), 1)"
    found = f"""
        flatten(transform(
            filter(flatten(transform(filter(flatten(transform(filter({table}, g -> contains(norm, g.key)), g -> g.names)), n -> norm rlike n.re), n -> n.rules)), r -> norm rlike r.re), r ->
            transform({matched}, y -> named_struct('s', y.s, 'back', -y.e, 'p', r.p, 'label', r.label, 'sure', r.sure))))
    """
    df = df.withColumn("found", F.expr(f"if(norm is null, null, sort_array({found}))"))
    # In order of start and descending end, a detection lies within an earlier one if it ends no later.
    outer = """
        aggregate(p, named_struct('reach', s, 'out', cast(array() as array<struct<s:int, back:int, p:int, label:string, sure:double>>)),
            (acc, x) -> if(-x.back <= acc.reach, acc, named_struct('reach', -x.back, 'out', concat(acc.out, array(x)))),
            acc -> acc.out)
    """
    reach = _running("ps", "-1", "greatest(a, -x.back)")
    kept = _pieces("found", "ps", f"flatten(zip_with(ps, {reach}, (p, s) -> {outer}))")
    df = df.withColumn("kept", F.coalesce(F.expr(kept), F.expr("cast(array() as array<struct<s:int, back:int, p:int, label:string, sure:double>>)")))
    df = df.withColumn("base_set", F.expr("if(w is null, cast(array() as array<string>), transform(filter(base, b -> size(b.at) > 0), b -> b.label))"))
    return df.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base_set")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.expr("concat(base_set, transform(kept, k -> k.label))"))), ",").alias("labels"),
        F.coalesce(F.expr("array_max(transform(kept, k -> k.sure))"), F.when(F.size("places") > 0, 0.5), F.lit(0.0)).alias("score"),
        F.expr("transform(kept, k -> named_struct('start', k.s, 'end', -k.back, 'rule', k.p, 'label', k.label))").alias("detections"),
    )
