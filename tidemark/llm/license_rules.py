"""License signature rules.

A rule is a phrase over lower-case words with one ``@`` in front of its gate word, its label,
a priority (smaller wins) and a confidence. Hand-written templates are expanded over the
versions and variants that exist, so the list holds a few hundred expressions.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    gate: str
    hint: str
    pattern: str
    label: str
    priority: int
    confidence: float


#: Phrases and labels that are always reported, wherever they stand.
BASE = [
    ("gnu general public @license", "gpl"),
    ("apache @license", "apache"),
    ("@cc by", "cc-by"),
    ("mit @license", "mit"),
]

_TAIL = "(?: only| or (?:at your option )?(?:any )?(?:later|newer|greater)(?: version)?)?"

#: label, versions as words, titles in front of the gate, hint word
_VERSIONED = [
    ("gpl", ("1", "2", "3"), "gnu (?:general public|gpl)", "gnu"),
    ("lgpl", ("2", "2 1", "3"), "gnu (?:lesser|library) general public", "general"),
    ("agpl", ("1", "3"), "gnu affero general public", "affero"),
    ("fdl", ("1 1", "1 2", "1 3"), "gnu free documentation", "documentation"),
    ("apache", ("1 0", "1 1", "2 0"), "apache(?: software)?", "apache"),
    ("mpl", ("1 0", "1 1", "2 0"), "mozilla public", "mozilla"),
    ("epl", ("1 0", "2 0"), "eclipse public", "eclipse"),
    ("cddl", ("1 0", "1 1"), "common development and distribution", "distribution"),
    ("eupl", ("1 0", "1 1", "1 2"), "european union public", "european"),
    ("afl", ("1 1", "1 2", "2 0", "2 1", "3 0"), "academic free", "academic"),
    ("osl", ("1 0", "1 1", "2 0", "2 1", "3 0"), "open software", "software"),
    ("artistic", ("1 0", "2 0"), "artistic", "artistic"),
    ("lppl", ("1 0", "1 1", "1 2", "1 3"), "latex project public", "latex"),
    ("apsl", ("1 0", "1 1", "1 2", "2 0"), "apple public source", "apple"),
    ("odc-by", ("1 0",), "open data commons attribution", "attribution"),
    ("odbl", ("1 0",), "open data commons open database", "database"),
    ("bsl", ("1 0",), "boost software", "boost"),
    ("bsl-business", ("1 1",), "business source", "business"),
    ("sspl", ("1",), "server side public", "server"),
    ("openrail", ("1", "2"), "(?:creativeml|bigscience) open ?rail(?: m)?", "rail"),
    ("upl", ("1 0",), "universal permissive", "permissive"),
    ("zpl", ("1 1", "2 0", "2 1"), "zope public", "zope"),
    ("php", ("3 0", "3 01"), "php", "php"),
    ("psf", ("2",), "python software foundation", "python"),
]

#: label, the license's name in front of "license" or "licence", hint word
_NAMED = [
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("mit", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("zlib", "(?:zlib|zlib libpng)", "zlib"),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd"),
    ("bsd", "bsd(?: style)?", "bsd"),
    ("ms-pl", "microsoft public", "microsoft"),
    ("ms-rl", "microsoft reciprocal", "microsoft"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("vim", "vim", "vim"),
    ("ruby", "ruby", "ruby"),
    ("ofl", "(?:sil )?open font", "font"),
    ("json", "json", "json"),
    ("beerware", "beer ?ware", "ware"),
    ("curl", "curl", "curl"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("proprietary", "commercial", "commercial"),
    ("proprietary", "proprietary", "proprietary"),
    ("proprietary", "end user", "user"),
]

#: Identifiers as written behind "SPDX-License-Identifier", with a hyphen or point as a blank.
_SPDX = (
    "0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 cc-by-4.0 cc-by-sa-4.0 "
    "cc0-1.0 cddl-1.0 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.1 lgpl-3.0 lppl-1.3c "
    "mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 osl-3.0 postgresql unlicense upl-1.0 vim wtfpl zlib"
).split()

_SHORT = {"gpl": ("1", "2", "3"), "lgpl": ("2", "21", "3"), "agpl": ("1", "3")}
_CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_WORDS = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?",
    "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Phrases that stand by themselves: phrase, hint, label, confidence.
_PHRASES = [
    ("released into the public @domain", "public", "public-domain", 0.8),
    ("(?:in|dedicated to) the public @domain", "public", "public-domain", 0.7),
    ("all rights @reserved", "rights", "all-rights-reserved", 0.6),
    ("permission is hereby granted free of @charge to any person", "permission", "mit", 0.9),
    ("without @warranty of any kind", "without", "no-warranty", 0.4),
    ("@redistribution and use in source and binary forms", "source", "bsd", 0.8),
    ("do what the fuck you want to public @license", "what", "wtfpl", 1.0),
    ("this work is @licensed under", "work", "licensed-work", 0.3),
    ("licensed under the same terms as perl @itself", "perl", "perl", 0.8),
    ("terms of the @license agreement", "terms", "license-agreement", 0.3),
    ("(?:under|released into|see) the @unlicense", "unlicense", "unlicense", 0.9),
    ("@unlicense org", "unlicense", "unlicense", 0.9),
]


def _name(words: str) -> str:
    return words.replace(" ", ".")


def rules() -> list[Rule]:
    """All rules but the base ones; a version's own rule comes before its family's."""
    found: list[tuple[str, str, str, int, float]] = []
    for label, versions, title, hint in _VERSIONED:
        for word in ("license", "licence"):
            for v in versions:
                version = f"(?: as published by the free software foundation)?(?: either)? (?:version|v) {v}" + ("" if " " in v else "(?: 0)?")
                found.append((f"{title} @{word}{version}{_TAIL}", hint, f"{label}-{_name(v)}", 10, 1.0))
                found.append((f"{title} @{word} {v}{_TAIL}", hint, f"{label}-{_name(v)}", 12, 0.9))
            found.append((f"{title} @{word}{_TAIL}", hint, label, 30, 0.7))
    for label, title, hint in _NAMED:
        for word in ("license", "licence"):
            found.append((f"{title} @{word}", hint, label, 25, 0.8))
        found.append((f"@licensed under (?:the )?{title}", hint, label, 26, 0.7))
    for spdx in _SPDX:
        found.append((f"spdx @license identifier {spdx.replace('-', ' ').replace('.', ' ')}{_TAIL}", "spdx", spdx, 5, 1.0))
    for label, versions in _SHORT.items():
        for v in versions:
            found.append((f"@{label}v{v}{_TAIL}", label, f"{label}-{v if len(v) == 1 else v[0] + '.' + v[1]}", 15, 0.9))
            dotted = v if len(v) == 1 else v[0] + " " + v[1]
            found.append((f"@{label} (?:version |v )?{dotted}(?: 0)?{_TAIL}", label, f"{label}-{_name(dotted)}", 16, 0.8))
    for kind in _CC:
        for v in _CC_VERSIONS:
            found.append((f"@cc {kind} {v}", "cc", f"cc-{kind.replace(' ', '-')}-{_name(v)}", 8, 1.0))
            found.append((f"creative @commons {_CC_WORDS[kind]}(?: international| unported| generic)?(?: (?:public )?license)?(?: version)? {v}", "creative", f"cc-{kind.replace(' ', '-')}-{_name(v)}", 9, 1.0))
        found.append((f"@cc {kind}", "cc", f"cc-{kind.replace(' ', '-')}", 20 - len(kind), 0.7))
        found.append((f"creative @commons {_CC_WORDS[kind]}", "creative", f"cc-{kind.replace(' ', '-')}", 28 - len(kind), 0.8))
    found.append(("@cc0(?: 1 0)?(?: universal)?", "cc0", "cc0-1.0", 8, 0.9))
    found += [(p, h, label, 40, c) for p, h, label, c in _PHRASES]
    return [Rule(p.split("@")[1].split()[0].split("(")[0], h, compiled(p), label, n, c) for p, h, label, n, c in found]


def compiled(phrase: str) -> str:
    """Expression over the words in front of the gate, each after a blank, then ``@`` and the words from the gate on."""
    left, right = phrase.split("@")
    return (f" {left.strip()}" if left.strip() else "") + f"@{right}(?= )"


def base_rules() -> list[Rule]:
    return [Rule(p.split("@")[1].split()[0], "", compiled(p), label, 0, 0.5) for p, label in BASE]
