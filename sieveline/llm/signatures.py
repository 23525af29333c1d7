"""Ordered license signatures: what to look for, how sure it is, what outranks what.

A family is written by hand: its label, a keyword that each of its matches must
hold, and the wordings of its name. The forms below turn every wording into
rules of descending priority: a machine-readable tag, an address, a grant in
words, a heading, a bare mention.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str             # lower-case text without which the pattern cannot match
    pattern: str
    priority: int            # higher wins
    confidence: float


# (label, keyword, wordings of the name, identifier, address or "")
FAMILIES = [
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version )?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,?(?: version)? ?v?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit", r"(?:the )?mit(?: \(expat\))? licen[cs]e", r"mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit-0", r"opensource\.org/licenses?/mit-0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2-clause|2-clause bsd|freebsd) licen[cs]e", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3-clause|3-clause bsd) licen[cs]e", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4-clause|4-clause bsd) licen[cs]e", r"bsd-4-clause", ""),
    ("0bsd", "bsd", r"(?:zero-clause bsd|bsd zero clause) licen[cs]e", r"0bsd", r"opensource\.org/licenses?/0bsd"),
    ("isc", "isc", r"isc licen[cs]e", r"isc", r"opensource\.org/licenses?/isc"),
    ("gpl-1.0", "general", r"gnu general public licen[cs]e,?(?: version)? ?v?1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general", r"gnu general public licen[cs]e,?(?: version)? ?v?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general", r"gnu general public licen[cs]e,?(?: version)? ?v?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/gpl(?:-3\.0)?"),
    ("lgpl-2.0", "general", r"gnu library general public licen[cs]e,?(?: version)? ?v?2(?:\.0)?", r"lgpl-2\.0(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "general", r"gnu lesser general public licen[cs]e,?(?: version)? ?v?2\.1", r"lgpl-2\.1(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "general", r"gnu lesser general public licen[cs]e,?(?: version)? ?v?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/lgpl(?:-3\.0)?"),
    ("agpl-3.0", "general", r"(?:gnu )?affero general public licen[cs]e,?(?: version)? ?v?3(?:\.0)?", r"agpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("gfdl-1.3", "documentation", r"gnu free documentation licen[cs]e,?(?: version)? ?(?:1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,?(?: version)? ?v?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,?(?: version)? ?v?2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,?(?: version)?(?: -)? ?v?1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,?(?: version)?(?: -)? ?v?2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e,?(?: version)? ?(?:1\.0)?", r"cddl-1\.0", r"opensource\.org/licenses?/cddl-1\.0"),
    ("cpl-1.0", "common", r"common public licen[cs]e,?(?: version)? ?(?:1\.0)?", r"cpl-1\.0", r"opensource\.org/licenses?/cpl1\.0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,?(?: version)? ?2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-2\.0"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e,?(?: version)? ?1(?:\.0)?", r"artistic-1\.0", r"opensource\.org/licenses?/artistic-1\.0"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e,?(?: version)? ?(?:1\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", r"opensource\.org/licenses?/zlib"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?", r"wtfpl", r"wtfpl\.net"),
    ("python-2.0", "python", r"python software foundation licen[cs]e", r"(?:python|psf)-2\.0", r"docs\.python\.org/3/license"),
    ("php-3.01", "php", r"php licen[cs]e,?(?: version)? ?3(?:\.01)?", r"php-3\.01", r"php\.net/license"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby", r"ruby-lang\.org/en/about/license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql\.org/about/licence"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", r"openssl\.org/source/license"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e,?(?: version)? ?(?:1\.1)?", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("eupl-1.2", "european", r"european union public licen[cs]e,?(?: v\.?| version)? ?(?:1\.[12])?", r"eupl-1\.[12]", r"joinup\.ec\.europa\.eu/[^\s]*eupl"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("odbl-1.0", "database", r"open database licen[cs]e,?(?: version)? ?(?:v?1\.0)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "data commons", r"open data commons attribution licen[cs]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain", r"public domain dedication and licen[cs]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("ogl-uk-3.0", "government", r"open government licen[cs]e,?(?: v| version)? ?(?:3(?:\.0)?)?", r"ogl-uk-3\.0", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("cc0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("busl-1.1", "business", r"business source licen[cs]e,?(?: version)? ?(?:1\.1)?", r"busl-1\.1", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e,?(?: version)? ?v?1?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e,?(?: version)? ?2(?:\.0)?", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("llama", "llama", r"llama(?: [23](?:\.\d)?)? community licen[cs]e", r"llama-?[23](?:\.\d)?", r"ai\.meta\.com/llama/license"),
    ("openrail-m", "rail", r"(?:bigscience )?(?:open)?rail(?:\+\+)?-m(?: licen[cs]e)?", r"openrail(?:\+\+)?-?m?", r"huggingface\.co/spaces/[^\s]*license"),
]

# Creative Commons clauses and what they are called in full
CC_CLAUSES = {"by": r"attribution", "by-sa": r"attribution[- ]share ?alike", "by-nd": r"attribution[- ]no ?deriv(?:ative)?s",
              "by-nc": r"attribution[- ]non ?commercial", "by-nc-sa": r"attribution[- ]non ?commercial[- ]share ?alike",
              "by-nc-nd": r"attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

# wordings that stand for no single license
NOTICES = [
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 20, 0.5),
    ("copyright", "©", r"© ?(?:19|20)\d\d", 20, 0.5),
    ("copyright", "(c)", r"\(c\) (?:19|20)\d\d", 20, 0.4),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 25, 0.6),
    ("proprietary", "proprietary", r"proprietary (?:and|&) confidential|confidential (?:and|&) proprietary", 40, 0.8),
    ("proprietary", "distribution", r"not for (?:public )?(?:re)?distribution", 35, 0.6),
    ("proprietary", "redistribut", r"(?:may|must) not be (?:copied|reproduced|redistributed)", 35, 0.7),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|is) (?:in|in to|into|to) the public domain", 45, 0.8),
    ("mit", "permission is hereby", r"permission is hereby granted, free of charge, to any person", 85, 0.95),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software", 84, 0.9),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 83, 0.9),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", 30, 0.7),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", 31, 0.7),
    ("agpl", "affero", r"affero general public licen[cs]e", 31, 0.7),
    ("cc", "creative commons", r"creative commons(?: licen[cs]e)?", 28, 0.5),
    ("license", "terms of", r"under the terms of (?:the|this) licen[cs]e", 15, 0.3),
]


def _rules() -> list[Rule]:
    made = [Rule(*n) for n in NOTICES]
    for label, keyword, name, spdx, address in FAMILIES:
        tag_word = "spdx-license-identifier"
        made.append(Rule(label, tag_word, rf"spdx-license-identifier: ?{spdx}(?![\w.-])", 100, 1.0))
        made.append(Rule(label, keyword, rf"licen[cs]ed under (?:the )?(?:terms of the )?{name}", 80, 0.95))
        made.append(Rule(label, keyword, rf"(?:released|distributed|available|published|covered) (?:under|by) (?:the )?{name}", 75, 0.9))
        made.append(Rule(label, keyword, rf"(?<![\w.]){name}(?!\w)", 50, 0.7))
        if address:
            made.append(Rule(label, address.split("\\")[0], address, 90, 0.98))
    for clause, full in CC_CLAUSES.items():
        short = clause.replace("-", "[- ]")
        for version in CC_VERSIONS:
            v = re.escape(version)
            label = f"cc-{clause}-{version}"
            made.append(Rule(label, "spdx-license-identifier", rf"spdx-license-identifier: ?cc-{clause}-{v}(?![\w.-])", 100, 1.0))
            made.append(Rule(label, "creativecommons", rf"creativecommons\.org/licenses/{clause}/{v}", 90, 0.98))
            made.append(Rule(label, "licen", rf"licen[cs]ed under (?:a |the )?(?:creative commons |cc[- ]){short}[- ]{v}(?![\w.]?\d)", 80, 0.95))
            made.append(Rule(label, "creative commons", rf"creative commons {full}(?: (?:international|unported|generic))?[- ]{v}", 70, 0.9))
            made.append(Rule(label, "cc", rf"(?<!\w)cc[- ]{short}[- ]{v}(?![\w.]?\d)", 55, 0.8))
        made.append(Rule(f"cc-{clause}", "cc", rf"(?<!\w)cc[- ]{short}(?![- ]?(?:\w))", 40, 0.6))
    return made


RULES = _rules()
