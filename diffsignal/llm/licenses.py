"""License scans by ordered signature rules (operator 6).

A few hundred regular expressions over a text's words: written signatures
(identifiers, addresses, sentences of license texts and their headers, short
forms like "GPLv3"), and the forms of words around license names (bare,
versioned, grant).  They are tried in order, most specific tier first.  A rule is gated by keywords: it
runs only on texts that hold all of its words, which one set intersection
finds.  Where detections overlap, one whose interval lies inside an interval
of an earlier tier, or of its own tier and longer, is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels and names of licenses, in lower-case words.
NAMES = {
    "gpl": "gnu general public license",
    "lgpl": "gnu lesser general public license",
    "lgpl-library": "gnu library general public license",
    "agpl": "gnu affero general public license",
    "fdl": "gnu free documentation license",
    "apache": "apache license",
    "apache-software": "apache software license",
    "mit": "mit license",
    "bsd": "bsd license",
    "bsd-2-clause": "bsd 2 clause license",
    "bsd-3-clause": "bsd 3 clause license",
    "isc": "isc license",
    "mpl": "mozilla public license",
    "epl": "eclipse public license",
    "cddl": "common development and distribution license",
    "cpl": "common public license",
    "eupl": "european union public licence",
    "artistic": "artistic license",
    "zlib": "zlib license",
    "bsl": "boost software license",
    "unlicense": "the unlicense",
    "ms-pl": "microsoft public license",
    "ms-rl": "microsoft reciprocal license",
    "osl": "open software license",
    "afl": "academic free license",
    "psf": "python software foundation license",
    "php": "php license",
    "ruby": "ruby license",
    "postgresql": "postgresql license",
    "openssl": "openssl license",
    "ofl": "sil open font license",
    "odbl": "open database license",
    "x11": "x11 license",
    "vim": "vim license",
    "wtfpl": "wtfpl",
    "cc0": "cc0",
    "cc-by": "cc by",
    "cc-by-sa": "cc by sa",
    "cc-by-nc": "cc by nc",
    "cc-by-nd": "cc by nd",
    "cc-by-nc-sa": "cc by nc sa",
    "cc-by-nc-nd": "cc by nc nd",
    "cc-attribution": "creative commons attribution",
    "cc-attribution-sa": "creative commons attribution sharealike",
    "cc-attribution-nc": "creative commons attribution noncommercial",
}
#: The contract's base phrases are these bare names.
BASE = ("gpl", "apache", "cc-by", "mit")
#: Forms of a license's name, in order: tier, confidence, words before, words after; V stands for a version, which is a small number, not a year, a count or a place in a list.
N = r"([1-9])(?: ([0-9]))?(?![^ ])(?! (?:files?|lines?|times|pages?|years?|days?|of|percent)(?![^ ]))"
V = rf"(?: (?:version|ver|v) {N}| v{N}| {N})"
FORMS = (
    ("grant-version", 1, 0.95, r"(?:licensed|released|distributed|published|available|made available) (?:under|by) (?:the terms of )?(?:the |an? )?", V),
    ("or-later", 0, 0.95, "", rf"{V} or (?:\(?at your option\)? )?(?:any )?later(?: version)?"),
    ("grant", 2, 0.85, r"(?:licensed|released|distributed|published|available|made available) (?:under|by) (?:the terms of )?(?:the |an? )?", ""),
    ("see", 2, 0.8, r"(?:see|governed by|subject to|terms of) (?:the )?", ""),
    ("version", 3, 0.75, "", V),
    ("name", 4, 0.5, "", ""),
)
# Identifiers of the public license list, by label, as they stand after a tag or alone.
IDENTIFIERS = {
    "mit": "MIT MIT-0 MIT-Modern-Variant X11", "apache-1.1": "Apache-1.1", "apache-2.0": "Apache-2.0", "bsd-2-clause": "BSD-2-Clause BSD-2-Clause-Patent", "bsd-3-clause": "BSD-3-Clause BSD-3-Clause-Clear",
    "bsd-4-clause": "BSD-4-Clause", "0bsd": "0BSD", "isc": "ISC", "gpl-1": "GPL-1.0 GPL-1.0-only GPL-1.0-or-later", "gpl-2": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0+",
    "gpl-3": "GPL-3.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0+", "lgpl-2": "LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later", "lgpl-2.1": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later", "lgpl-3": "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later",
    "agpl-3": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later", "mpl-1.1": "MPL-1.1", "mpl-2.0": "MPL-2.0", "epl-1.0": "EPL-1.0", "epl-2.0": "EPL-2.0", "cddl-1.0": "CDDL-1.0", "cddl-1.1": "CDDL-1.1", "cpl-1.0": "CPL-1.0",
    "eupl-1.1": "EUPL-1.1", "eupl-1.2": "EUPL-1.2", "artistic-1.0": "Artistic-1.0", "artistic-2.0": "Artistic-2.0", "zlib": "Zlib", "bsl-1.0": "BSL-1.0", "unlicense": "Unlicense", "wtfpl": "WTFPL", "ms-pl": "MS-PL", "ms-rl": "MS-RL",
    "osl-3.0": "OSL-3.0", "afl-3.0": "AFL-3.0", "psf-2.0": "PSF-2.0 Python-2.0", "php-3.01": "PHP-3.01", "ruby": "Ruby", "postgresql": "PostgreSQL", "openssl": "OpenSSL", "ofl-1.1": "OFL-1.1", "odbl-1.0": "ODbL-1.0", "vim": "Vim",
    "cc0": "CC0-1.0", "cc-by-3.0": "CC-BY-3.0", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-3.0": "CC-BY-SA-3.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-nd-4.0": "CC-BY-ND-4.0", "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0", "cc-by-nc-nd-4.0": "CC-BY-NC-ND-4.0",
}
#: Identifiers that are plain words count after a tag or a grant only.
WORDS_TOO = frozenset("isc ruby vim zlib unlicense postgresql openssl mit x11".split())
# Signatures in words: label, tier, confidence, pattern.
PHRASES = (
    ("mit", 0, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 1, 0.95, "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 1, 0.9, "the software is provided as is without warranty of any kind express or implied including but not limited to"),
    ("isc", 0, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 1, 0.9, "permission to use copy modify and (?:or )?distribute this software for any purpose"),
    ("bsd", 1, 1.0, "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", 0, 1.0, "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 0, 1.0, "all advertising materials mentioning features or use of this software must display"),
    ("bsd", 1, 0.8, "redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("zlib", 0, 1.0, "this software is provided as is without any express or implied warranty in no event"),
    ("zlib", 1, 0.9, "the origin of this software must not be misrepresented"),
    ("apache-2.0", 0, 1.0, "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", 1, 0.9, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 0, 1.0, "apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", 1, 0.9, "opensource org licenses apache 2 0"),
    ("apache-2.0", 2, 0.85, "(?:licensed|released|distributed|published|available) under (?:the )?apache (?:v ?)?2(?: 0)?"),
    ("apache-2.0", 3, 0.7, "apache v?2 0"),
    ("apache-2.0", 3, 0.7, "asl v?2 0"),
    ("gpl", 1, 0.95, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 1, 0.95, "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("gpl", 2, 0.8, "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", 2, 0.8, "you should have received a copy of the gnu lesser general public license along with this"),
    ("agpl", 2, 0.8, "you should have received a copy of the gnu affero general public license along with this"),
    ("gpl-2", 0, 0.95, "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl-3", 0, 0.95, "gnu org licenses gpl 3 0(?: html| txt)?"),
    ("gpl", 1, 0.9, "gnu org licenses gpl(?: html)?"),
    ("lgpl-2.1", 0, 0.95, "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", 0, 0.95, "gnu org licenses lgpl 3 0"),
    ("lgpl", 1, 0.9, "gnu org licenses lgpl(?: html)?"),
    ("agpl-3", 0, 0.95, "gnu org licenses agpl 3 0"),
    ("agpl", 1, 0.9, "gnu org licenses agpl(?: html)?"),
    ("mit", 1, 0.9, "opensource org licenses mit(?: license)?(?: php| html)?"),
    ("bsd-3-clause", 1, 0.9, "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 1, 0.9, "opensource org licenses bsd 2 clause"),
    ("isc", 1, 0.9, "opensource org licenses isc"),
    ("mpl-2.0", 0, 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 0, 0.95, "mozilla org mpl 2 0"),
    ("mpl", 1, 0.9, "mozilla org mpl"),
    ("epl-2.0", 0, 0.95, "eclipse org legal epl (?:2 0|v20)"),
    ("epl-1.0", 0, 0.95, "eclipse org legal epl v10"),
    ("bsl-1.0", 0, 1.0, "distributed under the boost software license version 1 0"),
    ("bsl-1.0", 0, 0.95, "boost org license 1 0 txt"),
    ("unlicense", 0, 1.0, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, 0.9, "unlicense org"),
    ("wtfpl", 0, 1.0, "do what the fuck you want to public license"),
    ("ofl-1.1", 0, 0.95, "scripts sil org ofl"),
    ("ofl-1.1", 1, 0.9, "this font software is licensed under the sil open font license"),
    ("odbl-1.0", 1, 0.9, "opendatacommons org licenses odbl"),
    ("pddl-1.0", 1, 0.9, "opendatacommons org licenses pddl"),
    ("odc-by-1.0", 1, 0.9, "opendatacommons org licenses by"),
    ("cc0", 0, 0.95, "creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain-mark", 0, 0.95, "creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc0", 1, 0.9, "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights"),
    ("psf", 1, 0.9, "python software foundation license(?: agreement)?"),
    ("eula", 3, 0.6, "end user license agreement"),
    ("proprietary", 2, 0.8, "(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 2, 0.8, "unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|document|software|material)"),
    ("proprietary", 3, 0.6, "no part of this (?:publication|document|book|work) may be reproduced"),
    ("public-domain", 3, 0.6, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 4, 0.4, "public domain"),
    ("all-rights-reserved", 4, 0.4, "all rights reserved"),
)
# Kinds of the attribution licenses: letters in an address and words in a name, and their versions.
COMMONS = (("by", ""), ("by-sa", " ?share ?alike"), ("by-nc", " ?non ?commercial"), ("by-nd", " ?no ?derivat(?:ive)?s?(?: works)?"), ("by-nc-sa", " ?non ?commercial ?share ?alike"), ("by-nc-nd", " ?non ?commercial ?no ?derivat(?:ive)?s?(?: works)?"))
# Short forms with a version, and the versions that exist.
SHORT = {"gpl": "1 2 3", "lgpl": "2 2.1 3", "agpl": "1 3", "mpl": "1 1.1 2", "epl": "1 2", "eupl": "1.1 1.2", "cddl": "1 1.1", "osl": "3", "afl": "3"}


def _written() -> list[tuple]:
    """(label, form, tier, confidence, pattern, and a keyword where the pattern does not tell it) of identifiers, attribution licenses and short forms."""
    out = []
    for label, names in IDENTIFIERS.items():
        for name in names.split():
            words = " ".join(re.sub(r"[^a-z0-9]", " ", name.lower()).split())
            out.append((label, "tag", 0, 1.0, f"spdx license identifier {words}"))
            out.append((label, "licensed-as", 1, 0.9, f"(?:licensed|released|distributed|published|available) (?:under|as) (?:the )?{words}"))
            out.append((label, "field", 1, 0.85, f"license {words}(?= (?:author|version|name|description|copyright|url|homepage|classifier)(?![^ ])|$)"))
            if words.split()[0] not in WORDS_TOO and label not in WORDS_TOO:
                out.append((label, "identifier", 3, 0.75, words))
                out.append((label, "operand", 1, 0.8, f"(?:or|and|with) {words}"))
    for kind, name in COMMONS:
        letters = kind.replace("-", " ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            out.append((label, "address", 0, 1.0, f"creativecommons org licenses {letters} {version}"))
            out.append((label, "name", 1, 0.95, f"creative commons attribution{name} {version}"))
            out.append((label, "letters", 2, 0.85, f"cc {letters} {version}"))
        out.append((f"cc-{kind}", "address", 1, 0.9, f"creativecommons org licenses {letters}"))
    for label, versions in SHORT.items():
        for v in versions.split():
            whole = v.replace(".", " ")
            end = "(?: 0)?" if "." not in v else ""
            out.append((f"{label}-{v}", "short", 2, 0.85, f"(?:gnu )?{label} (?:v ?|version )?{whole}{end}", label))
            for joined in (f"{label}v{whole}", f"{label}{whole}"):
                out.append((f"{label}-{v}", "joined", 2, 0.85, f"(?:gnu )?{joined}{end}", joined.split()[0]))
        out.append((label, "short", 4, 0.5, f"gnu {label}"))
    return out


LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    tier: int
    score: float
    pattern: re.Pattern
    keywords: frozenset[bytes]
    base: bool


def _rule(label: str, form: str, tier: int, score: float, before: str, name: str, after: str, base: bool, sure: list[str] | None = None) -> Rule:
    pattern = re.compile(f"(?<![^ ]){before}{name}{after}(?![^ ])".encode())
    sure = sure or _sure(name) + (before.split() if before.isascii() and before.replace(" ", "").isalpha() else [])
    return Rule(label, form, tier, score, pattern, frozenset(w.encode() for w in sure), base)


def _sure(pattern: str) -> list[str]:
    """Whole words that every match of a pattern holds: those outside its groups, repeats and look-aheads."""
    plain, depth = [], 0
    pattern = pattern.replace(" )?", " )? ").replace("(?: ", " (?: ").replace("(?= ", " (?= ")
    for c in re.sub(r" \?|\[[^]]*\](?:\{[^}]*\}|[?*+])*\??|\.(?:\{[^}]*\}|[?*+])\??|\\d[?*+]?", "\0", pattern):
        depth += (c == "(") - (c == ")")
        plain.append("\0" if depth or c in ")?" else c)
    return [w for w in "".join(plain).split(" ") if w.isalnum()]


def rules() -> list[Rule]:
    """All signatures in order of trial: every form of every name, and the phrases."""
    out = [_rule(label, form, tier, score, before, name, after, form == "name" and label in BASE) for label, name in NAMES.items() for form, tier, score, before, after in FORMS]
    out += [_rule(label, "phrase", tier, score, "", phrase, "", False) for label, tier, score, phrase in PHRASES]
    out += [_rule(label, form, tier, score, "", pattern, "", False, sure) for label, form, tier, score, pattern, *sure in _written()]
    return sorted(out, key=lambda r: r.tier)


RULES = rules()
KEYWORDS = frozenset(w for r in RULES for w in r.keywords)


def normal(text: str) -> bytes:
    """A text's words, lower-cased A-Z, joined by single spaces."""
    return b" ".join(text.encode("utf-8", "replace").translate(LETTERS).split())


def detect(words: bytes, gated: bool = True) -> list[tuple[int, int, int, str]]:
    """Every match as (rule number, begin, end, label) in bytes of ``words``; gated: with the keyword prefilter."""
    found = []
    held = KEYWORDS.intersection(words.split(b" ")) if gated else KEYWORDS
    if held:
        for k, r in enumerate(RULES):
            if r.keywords <= held:
                for m in r.pattern.finditer(words):
                    version = ".".join(g.decode() for g in m.groups() if g) if r.pattern.groups else ""
                    found.append((k, m.start(), m.end(), f"{r.label}-{version}" if version else r.label))
    return found


def suppressed(found: list[tuple[int, int, int, str]]) -> list[bool]:
    """Which detections lie inside one of an earlier tier, or inside a longer or earlier one of their own."""
    out = [False] * len(found)
    starts: list[int] = []
    reach: list[int] = []
    kept: list[tuple[int, int]] = []
    for tier in sorted({RULES[f[0]].tier for f in found}):
        own = sorted((i for i, f in enumerate(found) if RULES[f[0]].tier == tier), key=lambda i: (found[i][1], -found[i][2], found[i][0]))
        far = -1
        for i in own:
            _, a, b, _ = found[i]
            at = bisect_right(starts, a) - 1
            out[i] = b <= far or at >= 0 and reach[at] >= b
            if not out[i]:
                far = max(far, b)
                kept.append((a, b))
        kept.sort()
        starts, reach, far = [a for a, _ in kept], [], -1
        for _, b in kept:
            far = max(far, b)
            reach.append(far)
    return out


def scan_text(text: str | None, gated: bool = True) -> tuple[int, list[dict]]:
    """The number of words and the detections of one text, by first word, last word and rule."""
    if not text:
        return 0, []
    words = normal(text)
    n = words.count(b" ") + 1 if words else 0
    found = detect(words, gated)
    if not found:
        return n, []
    hidden = suppressed(found)
    out, at, passed = [], 0, 0
    first: dict[int, int] = {}
    for begin in sorted({f[1] for f in found}):
        passed += words.count(b" ", at, begin)
        at, first[begin] = begin, passed
    for (k, a, b, label), h in zip(found, hidden):
        r = RULES[k]
        out.append({"first": first[a], "last": first[a] + words.count(b" ", a, b), "label": label, "rule": f"{r.label}:{r.form}", "tier": r.tier, "score": r.score, "base": r.base, "kept": not h})
    return n, sorted(out, key=lambda d: (d["first"], d["last"], d["tier"], d["rule"]))


DETECTION = "struct<first:long,last:long,label:string,rule:string,tier:int,score:double,base:boolean,kept:boolean>"


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, n_words, detections): all matches with their word intervals, ``kept`` where not suppressed.

    docs: any table with doc_id and text; other columns are ignored.  A null
    or empty text has no words and no detections; repeated rows and null ids
    are scanned like others.
    """
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("tier", pa.int32()), ("score", pa.float64()), ("base", pa.bool_()), ("kept", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], kind)], names=["doc_id", "n_words", "detections"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, n_words long, detections array<{DETECTION}>")


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document the counts, first and last place, labels and best score of its license mentions.

    n_base, first_word, last_word and base_labels tell of the base phrases'
    places, suppressed or not; labels are theirs and those of all detections
    kept, sorted and joined by commas (empty: none); score is the best of the
    detections kept, 0 without any.
    """
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"])
    names = lambda found: F.transform(found, lambda d: d["label"])
    starts = F.transform(base, lambda d: d["first"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return license_scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names(base)).alias("base_labels"), joined(F.concat(names(base), names(kept))).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["score"])), F.lit(0.0)).alias("score"),
    )
