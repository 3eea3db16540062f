"""License scans by ordered signature rules. DataFrame functions only.

A rule is a regular expression with a label, a keyword any match contains, and a priority. Keywords hold no white space, as a
match may be wrapped or spaced in any way between its words. A text that holds none of the
rules' shortest common strings runs no expression; otherwise only rules whose keyword it holds run. Each gives its matches' intervals; one that lies
within another of higher priority (or of like priority and longer, or equal and of an earlier rule) is suppressed. What is
left are the text's detections. All of it happens within the row: nothing is shuffled.

The rules are statements written out one by one (clauses, notices, addresses and names of licenses, about a hundred) and, for
families of licenses, their names in the forms in which texts state them and their identifiers. Base places are found apart, by words: they stay whatever the rules say.

Null and empty texts have no words, detections or labels, and score 0. Rows that repeat are scanned each. Other columns are kept by scan(), but for those it
adds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 256
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same in texts that aren't lower-cased

#: Fixed phrases and labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Families: label, names as patterns of lower-case text (spaces stand for any white space), identifiers.
FAMILIES = [
    ("mit", ("mit", "expat", "x11"), ("mit", "x11", "mit-0", "mit-modern-variant")),
    ("apache", ("apache", "apache software"), ("apache-1.0", "apache-1.1", "apache-2.0")),
    ("gpl", ("gnu general public", "gnu gpl", "general public"), ("gpl-1.0", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "lesser general public", "gnu lgpl"), ("lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later")),
    ("agpl", ("gnu affero general public", "affero general public", "gnu agpl"), ("agpl-1.0", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later")),
    ("bsd", ("bsd", "new bsd", "revised bsd", "simplified bsd", "2-clause bsd", "3-clause bsd"), ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd")),
    ("mpl", ("mozilla public",), ("mpl-1.0", "mpl-1.1", "mpl-2.0")),
    ("epl", ("eclipse public",), ("epl-1.0", "epl-2.0")),
    ("cddl", ("common development and distribution",), ("cddl-1.0", "cddl-1.1")),
    ("isc", ("isc",), ("isc",)),
    ("zlib", ("zlib", "zlib/libpng"), ("zlib", "libpng-2.0")),
    ("boost", ("boost software",), ("bsl-1.0",)),
    ("artistic", ("artistic", "perl artistic"), ("artistic-1.0", "artistic-2.0")),
    ("eupl", ("european union public",), ("eupl-1.1", "eupl-1.2")),
    ("unlicense", ("unlicense", "the unlicense"), ("unlicense",)),
    ("wtfpl", ("do what the fuck you want to public",), ("wtfpl",)),
    ("cc-by", ("creative commons attribution",), ("cc-by-3.0", "cc-by-4.0")),
    ("cc-by-sa", ("creative commons attribution-sharealike", "creative commons attribution share alike"), ("cc-by-sa-3.0", "cc-by-sa-4.0")),
    ("cc-by-nc", ("creative commons attribution-noncommercial",), ("cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0")),
    ("cc0", ("creative commons zero", "cc0"), ("cc0-1.0",)),
    ("openssl", ("openssl",), ("openssl",)),
    ("python", ("python software foundation",), ("psf-2.0", "python-2.0")),
    ("postgresql", ("postgresql",), ("postgresql",)),
    ("ofl", ("sil open font", "open font"), ("ofl-1.1",)),
    ("odbl", ("open database",), ("odbl-1.0",)),
]

#: Forms in which a name is stated: pattern around {}, priority, weight.
FORMS = [
    (r"(?:licensed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{}\s+licen[cs]e(?:,?\s+(?:version|v\.?)\s*[0-9]+(?:\.[0-9]+)*)?", 30, 0.9),
    (r"{}\s+licen[cs]e,?\s+(?:version|v\.?)\s*[0-9]+(?:\.[0-9]+)*", 25, 0.8),
    (r"(?:see|read|subject\s+to|governed\s+by)\s+the\s+{}\s+licen[cs]e", 22, 0.7),
    (r"{}\s+licen[cs]e", 20, 0.6),
]
TAG = (r"spdx-license-identifier:\s*{}(?![a-z0-9.+-])", 40, 0.95)
#: Statements: label, keyword, pattern (a space stands for any white space), priority, weight, and a shorter common string if any.
TEXTS = [
    ("mit", "charge", "permission is hereby granted,? free of charge,? to any person", 35, 0.9),
    ("mit", "sublicense", "to use, copy, modify, merge, publish, distribute, sublicense,? and(?:/or)? sell", 34, 0.8),
    ("mit", "substantial", "included in all copies or substantial portions of the software", 34, 0.8),
    ("mit", "infringement", "fitness for a particular purpose and non-?infringement", 32, 0.6),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 35, 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 34, 0.8),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 34, 0.8),
    ("bsd", "endorse", "nor the names of its contributors may be used to endorse or promote products", 34, 0.8),
    ("bsd", "advertising", "all advertising materials mentioning features or use of this software must display", 34, 0.9),
    ("bsd", "contributors", "this software is provided by the copyright holders and contributors", 33, 0.7),
    ("bsd", "incidental", "in no event shall the (?:copyright (?:owner|holder)s?|regents|authors?)(?: or contributors)? be liable for any direct, indirect, incidental", 32, 0.6),
    ("bsd", "regents", "the regents of the university of california", 32, 0.6),
    ("isc", "permission", "permission to use, copy, modify, and(?:/or)? distribute this software", 35, 0.8),
    ("isc", "disclaim", "the authors? disclaims? all warranties with regard to this software", 34, 0.7),
    ("isc", "granted", "with or without fee is hereby granted, provided that the above copyright notice", 34, 0.7),
    ("gpl", "redistribute", "this program is free software[:;]? you can redistribute it", 35, 0.85),
    ("gpl", "foundation", "published by the free software foundation[,;]? either version [0-9]", 34, 0.8),
    ("gpl", "received", "you should have received a copy of the gnu general public licen[cs]e", 36, 0.9),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document", 34, 0.8),
    ("gpl", "exception", "as a special exception, the copyright holders? (?:of this library )?gives? (?:you )?permission to link", 34, 0.7),
    ("gpl", "gplv", r"(?<![a-z0-9])gplv[123](?:\.0)?(?![a-z0-9])", 30, 0.8),
    ("lgpl", "redistribute", "this library is free software[:;]? you can redistribute it", 36, 0.85),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", 36, 0.9),
    ("lgpl", "lgplv", r"(?<![a-z0-9])lgplv(?:2|2\.1|3)(?![a-z0-9])", 30, 0.8),
    ("agpl", "received", "you should have received a copy of the gnu affero general public licen[cs]e", 36, 0.9),
    ("agpl", "agplv", r"(?<![a-z0-9])agplv[13](?:\.0)?(?![a-z0-9])", 30, 0.8),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", 26, 0.8, "licen"),
    ("apache", "compliance", "you may not use this file except in compliance with the license", 35, 0.9),
    ("apache", "apache.org", r"apache\.org/licenses/license-[12]\.[01]", 38, 0.9),
    ("apache", "conditions", "basis,? without warranties or conditions of any kind", 34, 0.8),
    ("apache", "apache", "this product includes software developed (?:at|by) the apache (?:software foundation|group)", 34, 0.8),
    ("apache", "irrevocable", "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable", 34, 0.7),
    ("mpl", "mozilla.org", r"mozilla\.org/mpl", 38, 0.8),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public", 35, 0.9),
    ("mpl", "mozilla", "contents of this file are subject to the mozilla public", 35, 0.9),
    ("epl", "eclipse.org", r"eclipse\.org/legal/epl-", 38, 0.8),
    ("epl", "eclipse", "accompanying materials are made available under the terms of the eclipse public", 35, 0.9),
    ("cddl", "cddl", r"(?<![a-z0-9])cddl(?:-| v?)1\.[01]", 30, 0.8),
    ("cddl", "opensource.org", r"opensource\.org/licenses/cddl", 38, 0.8),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 35, 0.9),
    ("zlib", "plainly", "altered source versions must be plainly marked as such", 35, 0.9),
    ("zlib", "as-is", "as-is['\"]?, without any express or implied warranty", 30, 0.5),
    ("boost", "boost.org", r"boost\.org/license_1_0\.txt", 38, 0.9),
    ("boost", "machine-executable", "machine-executable object code generated by a source language processor", 35, 0.9),
    ("artistic", "perl", "same terms as perl itself", 32, 0.7),
    ("artistic", "artistic", "clarified artistic licen[cs]e", 26, 0.7, "licen"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 36, 0.95),
    ("unlicense", "unlicense.org", r"unlicense\.org", 38, 0.8),
    ("wtfpl", "wtfpl", "(?<![a-z0-9])wtfpl(?![a-z0-9])", 30, 0.8),
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/[1-4]\.[05]", 38, 0.9),
    ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]", 38, 0.9),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]", 38, 0.9),
    ("cc-by-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]", 38, 0.9),
    ("cc-by-nc-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]", 38, 0.9),
    ("cc-by-nc-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]", 38, 0.9),
    ("cc-by-sa", "attribution-share", r"attribution-share-?alike [1-4]\.[05] (?:international|unported|generic)", 32, 0.8),
    ("cc-by-nc", "attribution-non", r"attribution-non-?commercial [1-4]\.[05] (?:international|unported|generic)", 32, 0.8),
    ("cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0", 38, 0.9),
    ("cc0", "waived", "waived all copyright and related or neighbou?ring rights", 34, 0.8),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 34, 0.8),
    ("openssl", "cryptographic", "this product includes cryptographic software written by", 34, 0.7),
    ("python", "licensee", "psf is making python available to licensee", 34, 0.9),
    ("python", "beopen", "beopen python open source licen[cs]e agreement", 34, 0.9),
    ("postgresql", "documentation", "permission to use, copy, modify, and distribute this software and its documentation for any purpose", 36, 0.8),
    ("ofl", "bundled", "the fonts?(?: software)?, including any derivative works, can be bundled", 34, 0.9),
    ("ofl", "scripts.sil.org", r"scripts\.sil\.org/ofl", 38, 0.9),
    ("ofl", "reserved", "reserved font name", 30, 0.7),
    ("odbl", "opendatacommons.org", r"opendatacommons\.org/licenses/odbl", 38, 0.9),
    ("pddl", "opendatacommons.org", r"opendatacommons\.org/licenses/pddl", 38, 0.9),
    ("odc-by", "opendatacommons.org", r"opendatacommons\.org/licenses/by", 38, 0.9),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", 26, 0.8, "licen"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", 26, 0.8, "licen"),
    ("beerware", "beer", "you can buy me a beer in return", 34, 0.9),
    ("beerware", "beer-ware", "the ['\"]?beer-ware licen[cs]e", 26, 0.9, "licen"),
    ("json", "evil", "the software shall be used for good, not evil", 35, 0.9),
    ("afl", "academic", "academic free licen[cs]e", 26, 0.8, "licen"),
    ("osl", "open", "(?<![a-z0-9])open software licen[cs]e", 26, 0.8, "licen"),
    ("ncsa", "illinois", "university of illinois/ncsa open source licen[cs]e", 26, 0.9, "licen"),
    ("upl", "universal", "universal permissive licen[cs]e", 26, 0.8, "licen"),
    ("sspl", "server", "server side public licen[cs]e", 26, 0.9, "licen"),
    ("busl", "business", "business source licen[cs]e", 26, 0.8, "licen"),
    ("elastic", "elastic", "(?<![a-z0-9])elastic licen[cs]e", 26, 0.8, "licen"),
    ("commons-clause", "commons", "commons clause licen[cs]e condition", 34, 0.9, "licen"),
    ("ijg", "jpeg", "based in part on the work of the independent jpeg group", 34, 0.8),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?licen[cs]e", 26, 0.8, "licen"),
    ("php", "php", r"(?<![a-z0-9])php licen[cs]e,? (?:version )?3\.0[01]?", 26, 0.8, "licen"),
    ("zpl", "zope", "zope public licen[cs]e", 26, 0.8, "licen"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[cs]e", 26, 0.8, "licen"),
    ("ruby", "ruby", "same terms as ruby itself", 32, 0.7),
    ("cecill", "cecill", "(?<![a-z0-9])cecill(?:-[abc])?(?: free software)? licen[cs]e", 26, 0.8, "licen"),
    ("openrail", "openrail", "(?<![a-z0-9])openrail(?:-m|[+]{2})?(?![a-z0-9])", 28, 0.8),
    ("llama", "llama", r"llama (?:[1-9](?:\.[0-9])? )?community licen[cs]e", 28, 0.9, "licen"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in)?to the public domain", 30, 0.7),
    ("public-domain", "domain", "this (?:file|work|software|document|code) is (?:in|part of) the public domain", 30, 0.7),
    ("public-domain", "claimed", "no copyright (?:is )?claimed", 20, 0.5),
    ("public-domain", "reserved", "no rights reserved", 20, 0.6),
    ("public-domain", "government", r"work of the (?:united states|u\.s\.) government", 30, 0.6),
    ("proprietary", "reserved", "all rights reserved", 10, 0.3),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 15, 0.5),
    ("proprietary", "confidential", "strictly confidential", 12, 0.4),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document|material)", 15, 0.6),
    ("proprietary", "reproduced", "may not be reproduced (?:or [a-z]+ )?(?:in whole or in part )?without", 15, 0.5),
    ("proprietary", "secrets", "contains (?:valuable )?trade secrets", 15, 0.5),
    ("proprietary", "agreement", "end(?:-| )user licen[cs]e agreement", 26, 0.6, "licen"),
    ("proprietary", "commercial", "for personal,? (?:and )?non-?commercial use only", 15, 0.5),
    ("proprietary", "evaluation", "for evaluation purposes only", 15, 0.5),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    gate: str = ""  # a shorter string that any match contains too; the keyword itself if empty


def rules() -> list[Rule]:
    """All rules, the surest first; their number decides between equals."""
    out = [Rule(label, keyword, pattern.replace(" ", r"\s+"), *more) for label, keyword, pattern, *more in TEXTS]
    for label, names, ids in FAMILIES:
        for name in names:
            words = r"\s+".join(re.escape(w) for w in name.split())
            out += [Rule(label, name.split()[-1], r"(?<![a-z0-9])" + form.replace("{}", words) + r"(?![a-z0-9])", p, w, "licen") for form, p, w in FORMS]
        out += [Rule(label, "spdx-", r"(?<![a-z0-9])" + TAG[0].replace("{}", re.escape(i)), *TAG[1:]) for i in ids]
    return sorted(out, key=lambda r: (-r.priority, -len(r.pattern), r.label))


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixes(items: Column, zero: Column, of, plus) -> Column:
    """For each item the sum, by plus, of of(item) over those before it, from zero on.

    In blocks, as an array that grows by one item at a time is copied each time: the work is of n * (BLOCK + n / BLOCK**2).
    """
    empty = F.filter(F.array(zero), lambda x: F.lit(False))

    def run(block: Column, first: Column, each) -> Column:
        start = F.struct(first.alias("at"), empty.alias("out"))
        step = lambda a, x: F.struct(plus(a["at"], each(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(block, start, step, lambda a: a["out"])

    def dealt(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: plus(a, of(x))))
        return F.flatten(F.zip_with(blocks, run(totals, zero, lambda x: x), lambda b, first: run(b, first, of)))

    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0).cast("long"))
    return let(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.slice(items, (i * BLOCK + 1).cast("int"), F.lit(BLOCK))), dealt)


def intervals(text: Column, pattern: Column) -> Column:
    """(start, end) in characters of every match of a pattern that matches no empty string."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(xs: Column) -> Column:
        starts = prefixes(xs, F.lit(0), lambda x: x["gap"] + x["own"], lambda a, b: a + b)
        return F.zip_with(xs, starts, lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["own"]).alias("end")))

    def of(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(gaps, found, lambda g, f: F.struct(F.length(g).alias("gap"), F.length(f).alias("own")))
        return F.when(F.size(found) > 0, let(sizes, placed)).otherwise(none)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), of)


def detections(text: Column, rs: list[Rule]) -> Column:
    """Array of rule, start, end, priority: all matches of the candidate rules."""
    by: dict[tuple[str, str], list[int]] = {}
    for i, r in enumerate(rs):
        by.setdefault((r.gate or r.keyword, r.keyword), []).append(i)
    kind = "array<struct<rule:int,priority:int,pattern:string>>"
    table = [F.struct(F.lit(i).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rs)]
    candidates = F.flatten(F.array(*[F.when(F.contains(text, F.lit(g)) & F.contains(text, F.lit(k)), F.array(*[table[i] for i in ids])).otherwise(F.array().cast(kind)) for (g, k), ids in by.items()]))
    return F.flatten(
        F.transform(
            candidates,
            lambda c: F.transform(intervals(text, c["pattern"]), lambda x: F.struct(c["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"), c["priority"].alias("priority"))),
        )
    )


def unsuppressed(found: Column, rs: list[Rule]) -> Column:
    """Those that no other suppresses, in one sweep: by start, the longer first, what lies around a detection has been before it.

    So it is suppressed if, of those before it with its priority or a higher one, the furthest end is not before its own.
    """
    levels = sorted({r.priority for r in rs})
    ranks = F.array(*[F.lit(p) for p in levels])
    ends = lambda x: F.array(*[F.when(-x["p"] >= p, -x["e"]).otherwise(0) for p in levels])
    further = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))

    def kept(xs: Column) -> Column:
        before = prefixes(xs, F.array(*[F.lit(0) for _ in levels]), ends, further)
        free = lambda x, s: F.element_at(s, F.array_position(ranks, -x["p"]).cast("int")) < -x["e"]
        own = lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), (-x["e"]).alias("end"), (-x["p"]).alias("priority"))
        return F.array_sort(F.filter(F.zip_with(xs, before, lambda x, s: F.when(free(x, s), own(x))), lambda x: x.isNotNull()))

    order = F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("e"), (-x["priority"]).alias("p"), x["rule"].alias("rule")))
    return let(F.array_sort(order), kept)


def base_places(words: Column) -> Column:
    """Array of (start, label): where the fixed phrases' words stand one after another."""

    def places(phrase: str, label: str) -> Column:
        ws = phrase.split()
        here = F.filter(
            F.sequence(F.lit(0), F.size(words) - len(ws)),
            lambda i: _all([F.get(words, i + j) == w for j, w in enumerate(ws)]),
        )
        at = F.transform(here, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
        return F.when(F.size(words) >= len(ws), at).otherwise(F.array().cast("array<struct<start:int,label:string>>"))

    return F.concat(*[places(*x) for x in BASE])


def _all(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, rs: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, base (start, label), found (rule, start, end, priority), labels and score."""
    rs = rules() if rs is None else rs
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [c for c in docs.columns if c not in ("n_words", "base", "found", "labels", "score", "_low", "_words", "_all")]
    keywords = sorted({r.gate or r.keyword for r in rs} | {"license"})
    gate = "(?i)" + "|".join(re.escape(k) for k in keywords if not any(o != k and o in k for o in keywords))
    out = docs.select(*[F.col(f"`{c}`") for c in own], F.regexp_count(text, F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(text.rlike(gate), lower(text)).alias("_low"))
    none = F.array().cast("array<struct<start:int,label:string>>")
    hits = F.array().cast("array<struct<rule:int,start:int,end:int,priority:int>>")
    # One projection after another: what a lambda reads again is computed once.
    gated = F.col("_low").isNotNull()
    out = out.withColumn("_words", F.when(F.contains("_low", F.lit("license")), F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))))
    out = out.withColumn("base", F.when(F.col("_words").isNotNull(), base_places(F.col("_words"))).otherwise(none)).drop("_words")
    out = out.withColumn("_all", F.when(gated, detections(F.col("_low"), rs)).otherwise(hits)).drop("_low")
    out = out.withColumn("found", F.when(F.size("_all") > 0, unsuppressed(F.col("_all"), rs)).otherwise(hits)).drop("_all")
    label, weight = F.array(*[F.lit(r.label) for r in rs]), F.array(*[F.lit(r.weight) for r in rs])
    both = F.concat(F.transform("base", lambda x: x["label"]), F.transform("found", lambda x: F.get(label, x["rule"])))
    sure = F.when(F.size("base") > 0, 0.5).otherwise(0.0)
    miss = F.aggregate("found", F.lit(1.0), lambda a, x: a * (1 - F.get(weight, x["rule"])))
    return out.withColumns({"labels": F.array_sort(F.array_distinct(both)), "score": F.round(1 - (1 - sure) * miss, 6)})


def digests(result: DataFrame) -> DataFrame:
    at = F.transform("base", lambda x: x["start"].cast("long"))
    return result.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
