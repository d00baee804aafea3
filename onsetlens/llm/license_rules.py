"""Signatures of licences over lower-case words joined by single spaces.

A rule is (label, priority, gate, pattern): the pattern is tried only on texts that hold the
word ``gate``, or one of several words joined by ``|``; every match holds one of them.  Names are written by hand; tags, short ids and addresses follow from the ids.
"""

from __future__ import annotations

import re

# Phrases whose places are always counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

TAG, TEXT, NAME, ADDRESS, SHORT, HINT = 100, 90, 80, 70, 50, 20

# Public licence ids: label, words of the id after "spdx license identifier", gate, names by hand.
_LICENCES = r"""
mit | mit | mit | (?:the )?mit licen[cs]e | mit expat licen[cs]e | expat licen[cs]e
mit-0 | mit 0 | mit | mit no attribution(?: licen[cs]e)?
apache-1.1 | apache 1 1 | apache | apache (?:software )?licen[cs]e (?:version )?1 1
apache-2.0 | apache 2 0 | apache | apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)? | apache 2(?: 0)? licen[cs]e
bsd-2-clause | bsd 2 clause | bsd | (?:2|two) clause bsd(?: licen[cs]e)? | simplified bsd licen[cs]e | freebsd licen[cs]e
bsd-3-clause | bsd 3 clause | bsd | (?:3|three) clause bsd(?: licen[cs]e)? | (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause | bsd 4 clause | bsd | (?:4|four) clause bsd(?: licen[cs]e)? | original bsd licen[cs]e
bsd-zero | 0bsd | 0bsd | zero clause bsd(?: licen[cs]e)? | bsd zero clause(?: licen[cs]e)?
isc | isc | isc | isc licen[cs]e | internet systems consortium licen[cs]e
zlib | zlib | zlib | zlib licen[cs]e | zlib libpng licen[cs]e
libpng | libpng 2 0 | libpng | libpng licen[cs]e(?: version 2)?
gpl-1.0 | gpl 1 0(?: only| or later)? | gpl | gnu gpl v(?:ersion )? ?1 | gpl v1
gpl-2.0 | gpl 2 0(?: only| or later)? | gpl | gnu gpl (?:v|version )?2 | gpl ?v2 | gpl version 2
gpl-3.0 | gpl 3 0(?: only| or later)? | gpl | gnu gpl (?:v|version )?3 | gpl ?v3 | gpl version 3
lgpl-2.0 | lgpl 2 0(?: only| or later)? | lgpl | lgpl (?:v|version )?2 0 | gnu library gpl
lgpl-2.1 | lgpl 2 1(?: only| or later)? | lgpl | lgpl (?:v|version )?2 1 | gnu lesser gpl
lgpl-3.0 | lgpl 3 0(?: only| or later)? | lgpl | lgpl (?:v|version )?3(?: 0)? | lgplv3
agpl-1.0 | agpl 1 0(?: only| or later)? | agpl | affero gpl (?:v|version )?1
agpl-3.0 | agpl 3 0(?: only| or later)? | agpl | agpl (?:v|version )?3(?: 0)? | agplv3 | affero gpl
mpl-1.0 | mpl 1 0 | mpl | mozilla public licen[cs]e (?:version |v )?1 0
mpl-1.1 | mpl 1 1 | mpl | mozilla public licen[cs]e (?:version |v )?1 1
mpl-2.0 | mpl 2 0 | mpl | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
epl-1.0 | epl 1 0 | epl | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl-2.0 | epl 2 0 | epl | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
cddl-1.0 | cddl 1 0 | cddl | common development and distribution licen[cs]e
cpl-1.0 | cpl 1 0 | cpl | common public licen[cs]e(?: version 1 0)?
eupl-1.1 | eupl 1 1 | eupl | european union public licen[cs]e (?:version |v )?1 1
eupl-1.2 | eupl 1 2 | eupl | european union public licen[cs]e(?: (?:version |v )?1 2)?
artistic-1.0 | artistic 1 0 | artistic | artistic licen[cs]e(?: 1 0)? | perl artistic licen[cs]e
artistic-2.0 | artistic 2 0 | artistic | artistic licen[cs]e 2 0
bsl-1.0 | bsl 1 0 | bsl | boost software licen[cs]e(?: (?:version )?1 0)?
busl-1.1 | busl 1 1 | busl | business source licen[cs]e(?: 1 1)?
unlicense | unlicense | unlicense | the unlicense | unlicense org
wtfpl | wtfpl | wtfpl | do what the fuck you want to public licen[cs]e
cc0-1.0 | cc0 1 0 | cc0 | cc0 public domain dedication | creative commons zero
cc-by-1.0 | cc by 1 0 | cc | creative commons attribution 1 0
cc-by-2.0 | cc by 2 0 | cc | creative commons attribution 2 0
cc-by-2.5 | cc by 2 5 | cc | creative commons attribution 2 5
cc-by-3.0 | cc by 3 0 | cc | creative commons attribution 3 0
cc-by-4.0 | cc by 4 0 | cc | creative commons attribution 4 0(?: international)?
cc-by-sa-2.0 | cc by sa 2 0 | cc | creative commons attribution share ?alike 2 0
cc-by-sa-3.0 | cc by sa 3 0 | cc | creative commons attribution share ?alike 3 0
cc-by-sa-4.0 | cc by sa 4 0 | cc | creative commons attribution share ?alike 4 0
cc-by-nd-3.0 | cc by nd 3 0 | cc | creative commons attribution no ?deriv(?:ative)?s 3 0
cc-by-nd-4.0 | cc by nd 4 0 | cc | creative commons attribution no ?deriv(?:ative)?s 4 0
cc-by-nc-3.0 | cc by nc 3 0 | cc | creative commons attribution non ?commercial 3 0
cc-by-nc-4.0 | cc by nc 4 0 | cc | creative commons attribution non ?commercial 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | cc | creative commons attribution non ?commercial share ?alike 3 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-nd-3.0 | cc by nc nd 3 0 | cc | creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0
odbl-1.0 | odbl 1 0 | odbl | open (?:data commons open )?database licen[cs]e
odc-by-1.0 | odc by 1 0 | odc | open data commons attribution licen[cs]e
pddl-1.0 | pddl 1 0 | pddl | public domain dedication and licen[cs]e
gfdl-1.1 | gfdl 1 1(?: only| or later)? | gfdl | gnu free documentation licen[cs]e version 1 1
gfdl-1.2 | gfdl 1 2(?: only| or later)? | gfdl | gnu free documentation licen[cs]e version 1 2
gfdl-1.3 | gfdl 1 3(?: only| or later)? | gfdl | gnu free documentation licen[cs]e(?: version 1 3)?
ofl-1.1 | ofl 1 1 | ofl | sil open font licen[cs]e(?: version 1 1)?
python-2.0 | python 2 0 | python | python software foundation licen[cs]e(?: version 2)? | psf licen[cs]e
postgresql | postgresql | postgresql | postgresql licen[cs]e
php-3.01 | php 3 01 | php | php licen[cs]e (?:version )?3 01
ruby | ruby | ruby | ruby licen[cs]e
openssl | openssl | openssl | openssl licen[cs]e | ssleay licen[cs]e
ms-pl | ms pl | pl | microsoft public licen[cs]e
ms-rl | ms rl | rl | microsoft reciprocal licen[cs]e
osl-3.0 | osl 3 0 | osl | open software licen[cs]e (?:version |v )?3 0
afl-3.0 | afl 3 0 | afl | academic free licen[cs]e (?:version |v )?3 0
ncsa | ncsa | ncsa | university of illinois ncsa open source licen[cs]e | ncsa licen[cs]e
x11 | x11 | x11 | x11 licen[cs]e | mit x11 licen[cs]e
json | json | json | json licen[cs]e
vim | vim | vim | vim licen[cs]e
sspl-1.0 | sspl 1 0 | sspl | server side public licen[cs]e
elastic-2.0 | elastic 2 0 | elastic | elastic licen[cs]e 2 0
"""

# Sentences of licences and notices, by hand: label, priority, gate, pattern.
_TEXTS = (
    ("mit", TEXT, "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", TEXT, "granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", TEXT, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", TEXT, "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", TEXT, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", TEXT, "apache", r"licensed under the apache licen[cs]e version 2 0"),
    ("apache-2.0", TEXT, "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", TEXT, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2.0", NAME, "general", r"gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 2"),
    ("gpl-3.0", NAME, "general", r"gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 3"),
    ("gpl", SHORT, "general", r"gnu general public licen[cs]e"),
    ("gpl", SHORT, "gpl", r"under the gpl"),
    ("lgpl", NAME, "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", NAME, "library", r"(?:gnu )?library general public licen[cs]e"),
    ("agpl", NAME, "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("gpl-exception", NAME, "exception", r"(?:classpath|linking|gcc runtime library) exception"),
    ("cc-by", SHORT, "creative", r"creative commons attribution licen[cs]e"),
    ("cc-by-sa", SHORT, "sa", r"cc by sa"),
    ("cc-by-nd", SHORT, "nd", r"cc by nd"),
    ("cc-by-nc", SHORT, "nc", r"cc by nc"),
    ("cc-by-nc-sa", SHORT + 1, "nc", r"cc by nc sa"),
    ("cc-by-nc-nd", SHORT + 1, "nc", r"cc by nc nd"),
    ("cc", HINT, "creative", r"creative commons(?: licen[cs]e)?"),
    ("cc", ADDRESS, "creativecommons", r"creativecommons org licen[cs]es"),
    ("public-domain", SHORT, "domain", r"(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("public-domain", HINT, "domain", r"public domain"),
    ("copyright", HINT, "copyright", r"copyright(?: c)? (?:19|20)\d\d"),
    ("copyright", HINT, "copyright", r"copyright notice"),
    ("reserved", SHORT, "rights", r"some rights reserved"),
    ("warranty", HINT, "warranty", r"without (?:any )?warranty(?: of any kind)?"),
    ("warranty", HINT, "warranties", r"without warranties or conditions of any kind"),
    ("as-is", HINT, "provided", r"(?:software )?is provided as is"),
    ("proprietary", SHORT, "proprietary", r"proprietary and confidential"),
    ("proprietary", SHORT, "unauthorized", r"unauthorized copying of this file"),
    ("free-use", HINT, "free", r"free to (?:use|share|copy) and (?:adapt|modify|redistribute|distribute)"),
    ("share-alike", HINT, "alike", r"share alike"),
    ("licence", HINT, "licensed", r"licensed under(?: the terms of)?"),
    ("licence", HINT, "released", r"released under(?: the| a)? (?:[^ ]+ ){1,4}licen[cs]e"),
    ("licence", HINT, "licence", r"see the licence for"),
    ("licence", HINT, "license", r"see the license (?:for|file)"),
    ("bsd-zero", SHORT + 2, "0bsd", r"0bsd"),
    ("wtfpl", SHORT + 2, "wtfpl", r"wtfpl"),
    ("unlicense", SHORT + 2, "unlicense", r"unlicense"),
)


def _gate_of(name: str, gate: str) -> str:
    """The longest word outside groups; with an optional blank (``gpl ?v2``) the word may be joined to the next."""
    plain = re.sub(r"\([^)]*\)[?]?", " ", name)
    fixed = re.findall(r"(?<![^ ])[a-z0-9]{3,}(?= (?![?])|$)", plain)
    if fixed:
        return max(fixed, key=len)
    joined = re.findall(r"(?<![^ ])([a-z0-9]{3,}) [?]([a-z0-9]+)(?= |$)", plain)
    return f"{joined[0][0]}|{''.join(joined[0])}" if joined else gate


def _rules() -> list[tuple[str, int, str, str]]:
    rules = list(_TEXTS)
    for line in _LICENCES.strip().splitlines():
        label, tag, gate, *names = [part.strip() for part in line.split(" | ")]
        rules.append((label, TAG, "spdx", f"spdx licen[cs]e identifier {tag}"))
        rules.append((label, ADDRESS, "org", f"(?:spdx|opensource) org licen[cs]es? {tag}(?: html)?"))
        if " " in tag:
            rules.append((label, SHORT + 2, gate, tag))
        for name in names:
            rules.append((label, NAME, _gate_of(name, gate), name))
    return rules


def _whole(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


# (label, priority, gate words, pattern, place in the order); more than three hundred.
RULES = [(label, rank, tuple(gate.encode().split(b"|")), _whole(pattern), i) for i, (label, rank, gate, pattern) in enumerate(_rules())]
BASE_RULES = [(label, phrase.split()[0].encode(), _whole(phrase)) for phrase, label in BASE]
