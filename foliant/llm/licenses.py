"""License scans: ordered signature rules over a text's words, gated by keywords. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What isn't part of a word, once A-Z are lower-cased; and the words of a text whose letters are as they were.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that count as base places, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: What every match has: all the words of one of these, somewhere in it. A text has them whatever stands between its words.
GATES = (
    "licen", "copyright", "copies", "permission", "domain", "spdx", "gpl", "warrant", "redistribut", "rights", "cc0", "cc by", "commons", "opensource", "wtfpl",
    "mit no attribution", "clause bsd", "bsd zero", "same terms as", "for good", "unicode icu", "mulan psl", "open rail", "openrail", "proprietary and", "copying of this",
    "commercial use only", "advertising materials", "misrepresented", "source versions", "apache software", "free software foundation", "special exception", "classpath",
    "invariant", "mpl was", "free to copy", "possible under law", "attribution share", "attribution non", "attribution no", "reserved font", "font software", "openstreetmap",
    "openssl project", "object code or binary", "buy me a beer", "advertising or otherwise", "in no event",
)

VERSION = r"(?: version)?(?: v)? ?"
ADDRESSES = ["spdx license identifier", "opensource org", "spdx org"]
#: Licenses: label, keywords of which a text that names it has one, the words of the SPDX identifier, and a pattern of the words by which texts name it.
LICENSES = (
    ("mit", "mit licen|expat licen", "mit", r"(?:the )?(?:mit|expat) licen[cs]e|mit licensed"),
    ("mit-0", "mit no attribution", "mit 0", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11 licen", "x11", r"x11 licen[cs]e|mit x11 licen[cs]e"),
    ("apache-1.0", "apache", "apache 1 0", rf"apache (?:software )?licen[cs]e{VERSION}1 0"),
    ("apache-1.1", "apache", "apache 1 1", rf"apache (?:software )?licen[cs]e{VERSION}1 1"),
    ("apache-2.0", "apache", "apache 2 0", rf"apache (?:software )?licen[cs]e{VERSION}2(?: 0)?"),
    ("gpl-1.0", "general public|gpl", "gpl 1 0(?: only| or later)?", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}1(?: 0)?"),
    ("gpl-2.0", "general public|gpl", "gpl 2 0 only", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}2(?: 0)?"),
    ("gpl-2.0+", "general public|gpl", "gpl 2 0 or later", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}2(?: 0)?(?: of the licen[cs]e)? or (?:\w+ ){{0,3}}(?:later|newer)"),
    ("gpl-3.0", "general public|gpl", "gpl 3 0 only", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}3(?: 0)?"),
    ("gpl-3.0+", "general public|gpl", "gpl 3 0 or later", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}3(?: 0)?(?: of the licen[cs]e)? or (?:\w+ ){{0,3}}(?:later|newer)"),
    ("lgpl-2.0", "library general|lgpl", "lgpl 2 0(?: only| or later)?", rf"(?:gnu )?(?:library general public licen[cs]e|lgpl){VERSION}2(?: 0)?"),
    ("lgpl-2.1", "lesser general|lgpl", "lgpl 2 1(?: only| or later)?", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){VERSION}2 1"),
    ("lgpl-3.0", "lesser general|lgpl", "lgpl 3 0(?: only| or later)?", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){VERSION}3(?: 0)?"),
    ("agpl-3.0", "affero|agpl", "agpl 3 0(?: only| or later)?", rf"(?:gnu )?(?:affero general public licen[cs]e|agpl){VERSION}3(?: 0)?"),
    ("gfdl-1.1", "free documentation", "gfdl 1 1", rf"(?:gnu )?free documentation licen[cs]e{VERSION}1 1"),
    ("gfdl-1.2", "free documentation", "gfdl 1 2", rf"(?:gnu )?free documentation licen[cs]e{VERSION}1 2"),
    ("gfdl-1.3", "free documentation", "gfdl 1 3", rf"(?:gnu )?free documentation licen[cs]e{VERSION}1 3"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", r"(?:simplified |freebsd )bsd licen[cs]e|(?:bsd )?(?:2|two) clause bsd licen[cs]e|bsd 2 clause licen[cs]e"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", r"(?:new |modified |revised )bsd licen[cs]e|(?:3|three) clause bsd licen[cs]e|bsd 3 clause licen[cs]e"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", r"original bsd licen[cs]e|(?:4|four) clause bsd licen[cs]e|bsd 4 clause licen[cs]e"),
    ("0bsd", "bsd", "0bsd", r"zero clause bsd(?: licen[cs]e)?|bsd zero clause licen[cs]e"),
    ("isc", "isc licen", "isc", r"isc licen[cs]e"),
    ("mpl-1.0", "mozilla", "mpl 1 0", rf"mozilla public licen[cs]e{VERSION}1 0"),
    ("mpl-1.1", "mozilla", "mpl 1 1", rf"mozilla public licen[cs]e{VERSION}1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", rf"mozilla public licen[cs]e{VERSION}2(?: 0)?"),
    ("epl-1.0", "eclipse", "epl 1 0", rf"eclipse public licen[cs]e{VERSION}1 0"),
    ("epl-2.0", "eclipse", "epl 2 0", rf"eclipse public licen[cs]e{VERSION}2(?: 0)?"),
    ("edl-1.0", "eclipse", "edl 1 0", rf"eclipse distribution licen[cs]e(?:{VERSION}1 0)?"),
    ("cddl-1.0", "common development", "cddl 1 0", rf"common development and distribution licen[cs]e(?:{VERSION}1 0)?"),
    ("cpl-1.0", "common public", "cpl 1 0", rf"common public licen[cs]e(?:{VERSION}1 0)?"),
    ("ipl-1.0", "ibm public", "ipl 1 0", rf"ibm public licen[cs]e(?:{VERSION}1 0)?"),
    ("eupl-1.1", "european union", "eupl 1 1", rf"european union public licen[cs]e{VERSION}1 1"),
    ("eupl-1.2", "european union", "eupl 1 2", rf"european union public licen[cs]e{VERSION}1 2"),
    ("cecill-2.1", "cecill", "cecill 2 1", rf"cecill (?:free software )?licen[cs]e(?: agreement)?(?:{VERSION}2 1)?"),
    ("artistic-1.0", "artistic", "artistic 1 0", rf"artistic licen[cs]e{VERSION}1 0"),
    ("artistic-2.0", "artistic", "artistic 2 0", rf"artistic licen[cs]e{VERSION}2(?: 0)?"),
    ("zlib", "zlib", "zlib", r"zlib (?:libpng )?licen[cs]e"),
    ("libpng", "png", "libpng", r"(?:lib)?png (?:reference library )?licen[cs]e"),
    ("bsl-1.0", "boost", "bsl 1 0", rf"boost software licen[cs]e(?:{VERSION}1 0)?"),
    ("busl-1.1", "business source", "busl 1 1", rf"business source licen[cs]e(?:{VERSION}1 1)?"),
    ("sspl-1.0", "server side", "sspl 1 0", rf"server side public licen[cs]e(?:{VERSION}1)?"),
    ("elastic-2.0", "elastic", "elastic 2 0", rf"elastic licen[cs]e(?:{VERSION}2 0)?"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl|you want to public", "wtfpl", r"wtfpl|do what the \w+ you want to public licen[cs]e"),
    ("psf-2.0", "python software", "psf 2 0|python 2 0", r"python software foundation licen[cs]e"),
    ("php-3.01", "php licen", "php 3 01", rf"php licen[cs]e(?:{VERSION}3 01)?"),
    ("ruby", "ruby", "ruby", r"ruby licen[cs]e|same (?:terms|licen[cs]e) as ruby"),
    ("perl", "as perl", "artistic 1 0 perl", r"same terms as perl(?: itself)?"),
    ("openssl", "openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e"),
    ("w3c", "w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e"),
    ("ofl-1.1", "open font", "ofl 1 1", rf"(?:sil )?open font licen[cs]e(?:{VERSION}1 1)?"),
    ("upl-1.0", "universal permissive", "upl 1 0", rf"universal permissive licen[cs]e(?:{VERSION}1 0)?"),
    ("ms-pl", "microsoft public", "ms pl", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", "ms rl", r"microsoft reciprocal licen[cs]e"),
    ("afl-3.0", "academic free", "afl 3 0", rf"academic free licen[cs]e(?:{VERSION}3 0)?"),
    ("osl-3.0", "open software licen", "osl 3 0", rf"open software licen[cs]e(?:{VERSION}3 0)?"),
    ("ecl-2.0", "educational community", "ecl 2 0", rf"educational community licen[cs]e(?:{VERSION}2 0)?"),
    ("cc0-1.0", "cc0|commons zero", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero(?: licen[cs]e)?"),
    ("cc-by-3.0", "cc by|commons attribution", "cc by 3 0", rf"cc by{VERSION}3 0|creative commons attribution(?: licen[cs]e)?{VERSION}3 0"),
    ("cc-by-4.0", "cc by|commons attribution", "cc by 4 0", rf"cc by{VERSION}4 0|creative commons attribution(?: licen[cs]e)?{VERSION}4 0"),
    ("cc-by-sa-3.0", "cc by sa|commons attribution", "cc by sa 3 0", rf"cc by sa{VERSION}3 0|creative commons attribution share ?alike(?: licen[cs]e)?{VERSION}3 0"),
    ("cc-by-sa-4.0", "cc by sa|commons attribution", "cc by sa 4 0", rf"cc by sa{VERSION}4 0|creative commons attribution share ?alike(?: licen[cs]e)?{VERSION}4 0"),
    ("cc-by-nc-4.0", "cc by nc|commons attribution", "cc by nc 4 0", rf"cc by nc{VERSION}4 0|creative commons attribution non ?commercial(?: licen[cs]e)?{VERSION}4 0"),
    ("cc-by-nd-4.0", "cc by nd|commons attribution", "cc by nd 4 0", rf"cc by nd{VERSION}4 0|creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)?{VERSION}4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa|commons attribution", "cc by nc sa 4 0", rf"cc by nc sa{VERSION}4 0|creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?{VERSION}4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd|commons attribution", "cc by nc nd 4 0", rf"cc by nc nd{VERSION}4 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[cs]e)?{VERSION}4 0"),
    ("odbl-1.0", "open database", "odbl 1 0", r"open database licen[cs]e"),
    ("odc-by-1.0", "open data commons", "odc by 1 0", r"open data commons attribution licen[cs]e"),
    ("pddl-1.0", "public domain dedication", "pddl 1 0", r"public domain dedication and licen[cs]e"),
    ("json", "json licen|good not evil", "json", r"json licen[cs]e|used for good not evil"),
    ("beerware", "beerware|beer ware", "beerware", r"beer ?ware licen[cs]e"),
    ("vim", "vim licen", "vim", r"vim licen[cs]e"),
    ("agpl-1.0", "affero|agpl", "agpl 1 0", rf"affero general public licen[cs]e{VERSION}1(?: 0)?"),
    ("afl-2.1", "academic free", "afl 2 1", rf"academic free licen[cs]e{VERSION}2 1"),
    ("aladdin", "aladdin", "aladdin", r"aladdin free public licen[cs]e"),
    ("apsl-2.0", "apple public", "apsl 2 0", rf"apple public source licen[cs]e(?:{VERSION}2 0)?"),
    ("bittorrent-1.1", "bittorrent", "bittorrent 1 1", rf"bittorrent open source licen[cs]e(?:{VERSION}1 1)?"),
    ("blueoak-1.0.0", "blue oak", "blueoak 1 0 0", r"blue oak model licen[cs]e"),
    ("bsd-3-clause-clear", "clear bsd", "bsd 3 clause clear", r"clear bsd licen[cs]e"),
    ("bsd-2-clause-patent", "bsd", "bsd 2 clause patent", r"bsd (?:2 clause )?plus patent licen[cs]e"),
    ("bzip2", "bzip2", "bzip2 1 0 6", r"bzip2 (?:and libbzip2 )?licen[cs]e"),
    ("cc-by-2.0", "cc by|commons attribution", "cc by 2 0", rf"cc by{VERSION}2 0|creative commons attribution(?: licen[cs]e)?{VERSION}2 0"),
    ("cc-by-sa-2.0", "cc by sa|commons attribution", "cc by sa 2 0", rf"cc by sa{VERSION}2 0|creative commons attribution share ?alike(?: licen[cs]e)?{VERSION}2 0"),
    ("cc-by-nc-3.0", "cc by nc|commons attribution", "cc by nc 3 0", rf"cc by nc{VERSION}3 0|creative commons attribution non ?commercial(?: licen[cs]e)?{VERSION}3 0"),
    ("cc-by-nc-sa-3.0", "cc by nc sa|commons attribution", "cc by nc sa 3 0", rf"cc by nc sa{VERSION}3 0|creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?{VERSION}3 0"),
    ("cc-by-nc-nd-3.0", "cc by nc nd|commons attribution", "cc by nc nd 3 0", rf"cc by nc nd{VERSION}3 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[cs]e)?{VERSION}3 0"),
    ("cddl-1.1", "common development", "cddl 1 1", rf"common development and distribution licen[cs]e{VERSION}1 1"),
    ("cecill-b", "cecill", "cecill b", r"cecill b (?:free software )?licen[cs]e(?: agreement)?"),
    ("cecill-c", "cecill", "cecill c", r"cecill c (?:free software )?licen[cs]e(?: agreement)?"),
    ("clartistic", "clarified artistic", "clartistic", r"clarified artistic licen[cs]e"),
    ("cpal-1.0", "common public attribution", "cpal 1 0", rf"common public attribution licen[cs]e(?:{VERSION}1 0)?"),
    ("curl", "curl licen", "curl", r"curl licen[cs]e"),
    ("elastic-1.0", "elastic", "elastic 1 0", rf"elastic licen[cs]e{VERSION}1 0"),
    ("etalab-2.0", "etalab|licence ouverte", "etalab 2 0", rf"etalab open licen[cs]e(?:{VERSION}2 0)?|licence ouverte"),
    ("ftl", "freetype", "ftl", r"freetype (?:project )?licen[cs]e"),
    ("gl2ps", "gl2ps", "gl2ps", r"gl2ps licen[cs]e"),
    ("hpnd", "historical permission", "hpnd", r"historical permission notice and disclaimer"),
    ("icu", "icu licen|unicode icu", "icu", r"icu licen[cs]e|unicode icu terms of use"),
    ("ijg", "independent jpeg", "ijg", r"independent jpeg group licen[cs]e"),
    ("imagemagick", "imagemagick", "imagemagick", r"imagemagick licen[cs]e"),
    ("intel", "intel open", "intel", r"intel open source licen[cs]e"),
    ("lppl-1.3c", "latex project", "lppl 1 3c", rf"latex project public licen[cs]e(?:{VERSION}1 3c?)?"),
    ("miros", "miros", "miros", r"miros licen[cs]e"),
    ("mulanpsl-2.0", "mulan", "mulanpsl 2 0", rf"mulan (?:permissive software licen[cs]e|psl)(?:{VERSION}2)?"),
    ("naist-2003", "naist|nara institute", "naist 2003", r"nara institute of science and technology licen[cs]e|naist licen[cs]e"),
    ("ntp", "ntp licen", "ntp", r"ntp licen[cs]e"),
    ("odc-pddl", "open data commons", "pddl", r"open data commons public domain dedication"),
    ("ogl-uk-3.0", "open government", "ogl uk 3 0", rf"open government licen[cs]e(?:{VERSION}3 0)?"),
    ("oldap-2.8", "openldap", "oldap 2 8", rf"openldap public licen[cs]e(?:{VERSION}2 8)?"),
    ("osl-2.1", "open software licen", "osl 2 1", rf"open software licen[cs]e{VERSION}2 1"),
    ("polyform-nc-1.0.0", "polyform", "polyform noncommercial 1 0 0", r"polyform noncommercial licen[cs]e"),
    ("qpl-1.0", "q public", "qpl 1 0", rf"q public licen[cs]e(?:{VERSION}1 0)?"),
    ("rpl-1.5", "reciprocal public", "rpl 1 5", rf"reciprocal public licen[cs]e(?:{VERSION}1 5)?"),
    ("sissl", "sun industry", "sissl", r"sun industry standards source licen[cs]e"),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat (?:public )?licen[cs]e"),
    ("spl-1.0", "sun public", "spl 1 0", rf"sun public licen[cs]e(?:{VERSION}1 0)?"),
    ("tcl", "tcl tk", "tcl", r"tcl tk licen[cs]e"),
    ("unicode-dfs-2016", "unicode", "unicode dfs 2016", r"unicode (?:inc )?licen[cs]e agreement"),
    ("watcom-1.0", "watcom", "watcom 1 0", r"sybase open watcom public licen[cs]e"),
    ("zpl-2.1", "zope public", "zpl 2 1", rf"zope public licen[cs]e(?:{VERSION}2 1)?"),
    ("openrail-m", "openrail|open rail", "openrail m", r"(?:creativeml |bigcode |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?"),
    ("llama-community", "llama", "llama", r"llama (?:\d+ )*community licen[cs]e(?: agreement)?"),
)
#: Notices without a version or a license's name, and sentences of the licenses' own texts: label, keywords, pattern.
NOTICES = (
    ("apache", "apache licen", r"apache licen[cs]e"),
    ("gpl", "general public licen", r"(?:gnu )?general public licen[cs]e"),
    ("gpl", "gnu gpl", r"gnu gpl"),
    ("lgpl", "lesser general|library general", r"(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("bsd", "bsd", r"bsd (?:style |type )?licen[cs]e"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("creative-commons", "creative commons", r"creative commons(?: \w+){0,4} licen[cs]e"),
    ("cc-by", "cc by", r"cc by(?: nc| sa| nd)*"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain|public domain"),
    ("all-rights-reserved", "rights reserved|rights are reserved", r"all rights (?:are )?reserved"),
    ("all-rights-reserved", "rights reserved", r"no rights reserved|some rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:software |source )?licen[cs]e|proprietary and confidential"),
    ("proprietary", "copying of this", r"unauthori[sz]ed copying of this file(?: via any medium)? is strictly prohibited"),
    ("proprietary", "end user", r"end user licen[cs]e agreement"),
    ("proprietary", "non commercial use", r"for non commercial use only"),
    ("osi-approved", "osi approved", r"osi approved(?: open source)? licen[cs]e"),
    ("shareware", "shareware licen", r"shareware licen[cs]e"),
    ("freeware", "freeware licen", r"freeware licen[cs]e"),
    ("dual-license", "dual licen", r"dual licen[cs]ed"),
    ("see-license", "see the licen", r"see the licen[cs]e file(?: for (?:more )?(?:details|information))?"),
    ("see-license", "licen", r"licen[cs]e information can be found in the \w+ file"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "without limitation the rights", r"to deal in the software without restriction including without limitation the rights"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ntp", "supporting documentation", r"both that copyright notice and this permission notice appear in supporting documentation"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "express or implied", r"this software is provided as is without any express or implied warranty"),
    ("bsl-1.0", "obtaining a copy of the software", r"any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "unless required by applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("apache-2.0", "governing permissions", r"for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache-2.0", "contributor licen", r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "free software foundation", r"as published by the free software foundation"),
    ("gpl", "under the terms of the gnu", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "should have received", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "should have received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "should have received", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", "hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("gpl-exception", "special exception", r"as a special exception(?: the| if you)?"),
    ("gpl-classpath", "classpath exception", r"classpath exception"),
    ("gfdl", "invariant sections", r"with no invariant sections"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", "was not distributed", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("npl-1.1", "netscape public", r"netscape public licen[cs]e"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("cecill", "cecill", r"governed by the cecill licen[cs]e under french law"),
    ("artistic", "standard version", r"you may make and give away verbatim copies of the source form of the standard version"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("cc0-1.0", "waived all copyright", r"waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "extent possible under law", r"to the extent possible under law the authors? (?:has|have|who associated)"),
    ("creative-commons", "creativecommons org", r"creativecommons org licenses \w+(?: \w+){0,3}"),
    ("cc-by-sa", "share alike|sharealike", r"attribution share ?alike(?: licen[cs]e)?"),
    ("cc-by-nc", "non commercial|noncommercial", r"attribution non ?commercial(?: licen[cs]e)?"),
    ("cc-by-nd", "no deriv|noderiv", r"attribution no ?deriv(?:ative)?s(?: licen[cs]e)?"),
    ("ofl-1.1", "reserved font", r"with reserved font names?"),
    ("ofl-1.1", "font software", r"the font software may be modified altered or added to"),
    ("odbl-1.0", "openstreetmap", r"openstreetmap contributors"),
    ("psf-2.0", "psf licen", r"psf licen[cs]e agreement for python"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("ruby", "distribute the software in", r"you may distribute the software in object code or binary form"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "used for good", r"the software shall be used for good"),
    ("curl", "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("x11", "advertising or otherwise", r"shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?"),
    ("warranty-disclaimer", "warrant", r"(?:provided )?\S?as is\S? without warranty of any kind"),
    ("warranty-disclaimer", "warrant", r"without (?:any|even the implied) warranty"),
    ("warranty-disclaimer", "warrant", r"without warranties or conditions of any kind"),
    ("warranty-disclaimer", "merchantability", r"implied warranties of merchantability(?: and| or)? fitness for a particular purpose"),
    ("liability-disclaimer", "in no event", r"in no event shall the (?:authors?|copyright (?:holders?|owners?))(?: or (?:contributors|copyright holders))? be liable"),
    ("patent-grant", "patent licen", r"(?:royalty free |irrevocable )+(?:copyright |patent )?patent licen[cs]e"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
)

GRANT = r"(?:(?:dual )?licensed|released|distributed|available|published|provided|redistribute it|redistributed|covered|governed) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


def rules() -> list[dict]:
    """All rules, in order: by license its identifiers and addresses, grants and names; then notices.

    Each rule has keywords of its own, of which every match has one.
    """
    out = []
    for label, keywords, spdx, names in LICENSES:
        out.append({"label": label, "keywords": ADDRESSES, "priority": 100, "pattern": rf"(?:spdx license identifier|opensource org licenses?|spdx org licenses) (?:{spdx})"})
        out.append({"label": label, "keywords": keywords.split("|"), "priority": 90, "pattern": rf"{GRANT}(?:{names})"})
        out.append({"label": label, "keywords": keywords.split("|"), "priority": 70, "pattern": names})
    for label, keywords, pattern in NOTICES:
        out.append({"label": label, "keywords": keywords.split("|"), "priority": 40, "pattern": pattern})
    return [{**rule, "pattern": rf"(?<![^ ])(?:{rule['pattern']})(?![^ ])", "place": i} for i, rule in enumerate(out)]


RULE = "struct<label: string, priority: int, pattern: string, place: int>"
HIT = "struct<start: int, stop: int, label: string, priority: int, place: int>"


def _words(s: Column) -> Column:
    s = F.trim(s)
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)


def _hits(line: Column, rule: Column) -> Column:
    """Where a rule's matches begin and end, in words: from the pieces between them."""
    pieces = F.arrays_zip(F.split(line, rule.pattern).alias("gap"), F.regexp_extract_all(line, rule.pattern, F.lit(0)).alias("text"))
    counted = F.transform(pieces, lambda p: F.struct(_words(p["gap"]).alias("gap"), _words(F.coalesce(p["text"], F.lit(""))).alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc.at + p["gap"]
        hit = F.struct(begin.alias("start"), (begin + p["text"]).alias("stop"), rule.label.alias("label"), rule.priority.alias("priority"), rule.place.alias("place"))
        return F.struct((begin + p["text"]).alias("at"), F.when(p["text"] > 0, F.concat(acc.out, F.array(hit))).otherwise(acc.out).alias("out"))

    found = F.aggregate(counted, start, add, lambda acc: acc.out)
    return F.when(F.regexp_like(line, rule.pattern), found).otherwise(F.array().cast(f"array<{HIT}>"))


def _table(known: list[dict]) -> Column:
    """The rules, together by their keywords: array of (keywords, rules)."""
    groups: dict[tuple, list[dict]] = {}
    for rule in known:
        groups.setdefault(tuple(rule["keywords"]), []).append({k: rule[k] for k in ("label", "priority", "pattern", "place")})
    rows = [{"keywords": list(k), "rules": v} for k, v in groups.items()]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<keywords: array<string>, rules: array<{RULE}>>>")


def matches(line: Column, known: list[dict]) -> Column:
    """All matches of all rules: array of HIT. A rule runs if one of its keywords is in the line."""
    near = F.filter(_table(known), lambda g: F.exists(g.keywords, lambda k: F.contains(line, k)))
    return F.flatten(F.transform(F.flatten(F.transform(near, lambda g: g.rules)), lambda r: _hits(line, r)))


def detections(line: Column, known: list[dict]) -> Column:
    """The rules' matches without those that others suppress: array of HIT in the order of priority.

    Higher priorities first, then longer matches, then earlier ones, then the rules' order: a match stays unless it
    overlaps one that stays with a higher priority, or lies within one that stays with the same.
    """
    order = F.transform(matches(line, known), lambda h: F.struct((-h.priority).alias("low"), (h.start - h.stop).alias("short"), h.start.alias("start"), h.place.alias("place"), h.label.alias("label")))
    start = F.array().cast(f"array<{HIT}>")

    def keep(kept: Column, h: Column) -> Column:
        stop, priority = h.start - h.short, -h.low
        within = lambda k: (k.start <= h.start) & (stop <= k.stop)
        overlaps = lambda k: (k.start < stop) & (h.start < k.stop)
        lost = F.exists(kept, lambda k: within(k) | ((k.priority > priority) & overlaps(k)))
        hit = F.struct(h.start.alias("start"), stop.alias("stop"), h.label.alias("label"), priority.alias("priority"), h.place.alias("place"))
        return F.when(lost, kept).otherwise(F.concat(kept, F.array(hit)))

    return F.aggregate(F.array_sort(order), start, keep)


def scan(df: DataFrame, *, text: str = "text", base: tuple[tuple[str, str], ...] = BASE, known: list[dict] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and detections; columns of these names are replaced.

    Texts without any gate are counted only; the others become one line of words, on which the rules run that have a
    keyword in it. Null texts are empty; equal texts and repeated rows get equal values; a long text is one line, whose
    matches take memory in proportion to their number. score is the highest priority of a detection, or of a base
    phrase, as a share of 100. No shuffle; nothing depends on other rows, and an empty table gives an empty one.
    """
    value, gated = F.coalesce(F.col(text), F.lit("")), F.lit(False)
    for g in GATES:
        both = F.lit(True)
        for w in g.split():
            both = both & F.contains(F.col("__low"), F.lit(w))
        gated = gated | both
    line = F.when(gated, F.trim(F.regexp_replace(F.translate(F.col("__value"), UPPER, LOWER), GAP, " ")))
    phrases = [{"label": label, "keywords": [phrase], "priority": 60, "pattern": rf"(?<![^ ]){phrase}(?![^ ])", "place": i} for i, (phrase, label) in enumerate(base)]
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    kept = [c for c in df.columns if c not in added]
    rows = df.select(*(df[c] for c in kept), value.alias("__value"), F.lower(value).alias("__low"))
    rows = rows.select(*kept, F.regexp_count("__value", F.lit(RAW_WORD)).cast("long").alias("n_words"), line.alias("__line"))
    none, known_line = F.array().cast(f"array<{HIT}>"), F.col("__line").isNotNull()
    rows = rows.withColumn("__base", F.when(known_line, matches(F.col("__line"), phrases)).otherwise(none))
    rows = rows.withColumn("detections", F.when(known_line, detections(F.col("__line"), known or rules())).otherwise(none))
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h.label))), ",")
    starts, both = F.transform("__base", lambda h: h.start), F.concat("__base", "detections")
    return rows.select(
        *(c for c in rows.columns if c not in ("__line", "__base", "detections")), F.size("__base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), names(F.col("__base")).alias("base_labels"), names(both).alias("labels"),
        F.coalesce(F.array_max(F.transform(both, lambda h: h.priority)) / 100, F.lit(0.0)).alias("score"), "detections",
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
