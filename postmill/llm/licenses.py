"""License scans: ordered signature rules gated by keywords, in Spark SQL functions alone.

A text becomes one line of words. Rules run only where one of their keywords stands, each in its order of priority; a
detection that lies within a longer one, or equals one of higher priority, is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import free_name

#: Fixed base phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: What parts words, once A-Z are lower case: every ASCII character but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """A signature: its place in the order (lower wins), keywords of which each text that it fits holds one, label, pattern over words with one blank between, and confidence in hundredths."""

    priority: int
    keywords: tuple[str, ...]
    label: str
    pattern: str
    weight: int


#: Families: label, keywords (split by |; each name holds one), names as patterns, versions (as words) that the family has.
FAMILIES = (
    ("agpl", "affero|agpl", r"(?:gnu )?affero general public licen[sc]e|agpl", ("1 0", "3 0", "3")),
    ("lgpl", "lesser general|library general|lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    ("gpl", "general public|gpl", r"(?:gnu )?general public licen[sc]e|gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("fdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cpl", "common public", r"common public licen[sc]e", ("0 5", "1 0")),
    ("eupl", "european union", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("osl", "open software", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", r"academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1 0", "2 0")),
    ("boost", "boost software", r"boost software licen[sc]e", ("1 0",)),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ()),
    ("mit", "mit|expat|x11", r"(?:mit|expat|x11) (?:style )?licen[sc]e", ()),
    ("isc", "isc", r"isc licen[sc]e", ()),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", ()),
    ("wtfpl", "do what the|wtfpl", r"do what the \S+ you want to public licen[sc]e|wtfpl", ("1", "2")),
    ("odbl", "open database", r"open database licen[sc]e", ("1 0",)),
    ("unlicense", "unlicen", r"the unlicen[sc]e", ()),
    ("python", "python software", r"python software foundation licen[sc]e", ("2", "2 0")),
    ("openssl", "openssl", r"openssl licen[sc]e", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ()),
    ("ecl", "educational community", r"educational community licen[sc]e", ("1 0", "2 0")),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", ("1 0",)),
)
#: Creative Commons: condition letters, their spelled-out names, and versions.
CC_TERMS = (("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by sa", "attribution share ?alike"), ("by", "attribution"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: SPDX identifiers, as words, that an SPDX line may name, and that count by themselves if they hold a version.
SPDX = (
    "0bsd aal afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 "
    "cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later "
    "libpng lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa nosl ntp odbl-1.0 odc-by-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unicode-3.0 unlicense upl-1.0 vim w3c watcom-1.0 wtfpl x11 zlib zpl-2.1"
).split()
#: First words that name nothing but a licence; beside others a version counts only near a word for licence.
TELLING = frozenset("agpl cddl cecill epl eupl gfdl gpl lgpl lppl mpl odbl ofl sspl wtfpl".split())
CUE = r"(?:licen[sc]e[ds]?|licensing)"
#: Short names that count behind such a word.
SHORT = ("mit", "bsd", "isc", "zlib", "apache", "unlicense")
#: Single signatures: keywords (split by |), label, pattern, weight.
SINGLE = (
    ("permission is hereby", "mit", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", 95),
    ("permission to use", "isc", r"permission to use copy modify and or distribute this software for any purpose", 95),
    ("redistribution", "bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 95),
    ("provided as is", "zlib", r"this software is provided as is without any express or implied warranty", 70),
    ("free software", "gpl", r"this program is free software you can redistribute it and or modify it", 90),
    ("public domain", "public-domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", 90),
    ("public domain", "public-domain", r"in the public domain", 70),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 95),
    ("cc zero", "cc0", r"cc zero", 90),
    ("rights reserved", "reserved", r"(?:all|some|no) rights reserved", 80),
    ("proprietary", "proprietary", r"proprietary and confidential", 90),
    ("confidential", "proprietary", r"strictly confidential", 70),
    ("not be reproduced", "proprietary", r"(?:may|must) not be reproduced", 75),
    ("unauthorized|unauthorised", "proprietary", r"unauthori[sz]ed (?:copying|use|distribution|reproduction)", 80),
    ("copyright", "copyright", r"copyright (?:c )?\d{4}(?: \d{4}){0,3}", 60),
    ("copyright", "copyright", r"copyright (?:c )?(?:by )?(?:the )?(?:author|authors|copyright holder|copyright holders)", 60),
    ("spdx", "spdx", r"spdx licen[sc]e identifier \S+", 99),
    ("end user", "eula", r"end user licen[sc]e agreement", 85),
    ("terms of", "terms", r"terms of (?:use|service)", 50),
    ("creative commons", "cc", r"creative commons", 60),
    ("above copyright notice and this permission notice", "mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 95),
    ("software is provided as is", "mit", r"the software is provided as is without warranty of any kind express or implied", 85),
    ("authors or copyright holders be liable", "mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 85),
    ("without restriction", "mit", r"to deal in the software without restriction", 85),
    ("redistributions of source code", "bsd", r"redistributions of source code must retain the (?:above )?copyright notice", 90),
    ("redistributions in binary form", "bsd", r"redistributions in binary form must reproduce the (?:above )?copyright notice", 90),
    ("endorse or promote", "bsd-3-clause", r"(?:may|must not|nor) (?:not )?be used to endorse or promote products derived from this software", 90),
    ("advertising materials", "bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 95),
    ("copyright holders and contributors", "bsd", r"provided by the copyright holders and contributors as is", 85),
    ("you may not use this file", "apache", r"you may not use this file except in compliance with the licen[sc]e", 95),
    ("you may obtain a copy", "apache", r"you may obtain a copy of the licen[sc]e at", 80),
    ("unless required by applicable law", "apache", r"unless required by applicable law or agreed to in writing", 90),
    ("apache org licenses", "apache", r"apache org licenses licen[sc]e", 90),
    ("apache org licenses", "apache-2.0", r"apache org licenses licen[sc]e 2 0", 97),
    ("as published by", "gpl", r"as published by the free software foundation", 90),
    ("in the hope that it will be useful", "gpl", r"distributed in the hope that it will be useful but without any warranty", 90),
    ("should have received a copy", "gpl", r"you should have received a copy of the gnu general public licen[sc]e", 92),
    ("should have received a copy", "lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 92),
    ("should have received a copy", "agpl", r"you should have received a copy of the gnu affero general public licen[sc]e", 92),
    ("gnu org licenses", "gpl", r"gnu org licenses(?: gpl)?", 80),
    ("copyleft", "gpl", r"(?:strong|weak) copyleft licen[sc]e", 60),
    ("linking exception|classpath|runtime library", "gpl-exception", r"(?:classpath|linking|runtime library) exception", 80),
    ("source code form is subject", "mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 97),
    ("mozilla org mpl", "mpl", r"mozilla org mpl(?: 2 0)?", 85),
    ("program and the accompanying materials", "epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 97),
    ("permission to use copy modify", "isc", r"permission to use copy modify and distribute this software(?: and its documentation)? for any purpose", 88),
    ("author disclaims all warranties", "isc", r"the author disclaims all warranties with regard to this software", 85),
    ("altered source versions", "zlib", r"altered source versions must be plainly marked as such", 92),
    ("origin of this software", "zlib", r"the origin of this software must not be misrepresented", 92),
    ("free and unencumbered", "unlicense", r"this is free and unencumbered software released into the public domain", 97),
    ("anyone is free to copy", "unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 92),
    ("unlicense org", "unlicense", r"unlicense org", 85),
    ("boost org", "boost", r"boost org licen[sc]e 1 0", 92),
    ("obtaining a copy of the software and accompanying documentation", "boost", r"to any person or organization obtaining a copy of the software and accompanying documentation", 95),
    ("reserved font name", "ofl", r"with reserved font names?", 90),
    ("scripts sil org", "ofl", r"scripts sil org ofl", 90),
    ("academic free", "afl", r"licensed under the academic free licen[sc]e", 92),
    ("package may be distributed under the same terms as perl", "artistic", r"package may be distributed under the same terms as perl", 85),
    ("same terms as perl", "artistic", r"under the same terms as perl(?: itself)?", 80),
    ("latex project public", "lppl", r"latex project public licen[sc]e", 92),
    ("server side public", "sspl-1.0", r"server side public licen[sc]e", 95),
    ("business source", "busl-1.1", r"business source licen[sc]e", 92),
    ("elastic licen", "elastic", r"elastic licen[sc]e(?: 2 0)?", 90),
    ("commons clause", "commons-clause", r"commons clause(?: licen[sc]e condition)?", 90),
    ("polyform", "polyform", r"polyform (?:noncommercial|strict|shield|small business|free trial) licen[sc]e", 95),
    ("cecill", "cecill", r"cecill (?:[bc] )?(?:free software )?licen[sc]e", 92),
    ("microsoft public", "ms-pl", r"microsoft public licen[sc]e", 92),
    ("microsoft reciprocal", "ms-rl", r"microsoft reciprocal licen[sc]e", 92),
    ("mulan", "mulanpsl", r"mulan permissive software licen[sc]e", 92),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", 92),
    ("php licen", "php", r"php licen[sc]e(?: version)?(?: 3 0\d?)?", 88),
    ("ruby licen", "ruby", r"(?:the )?ruby licen[sc]e", 85),
    ("vim licen", "vim", r"vim licen[sc]e", 88),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", 90),
    ("w3c", "w3c", r"w3c software (?:notice|and document notice)(?: and licen[sc]e)?", 90),
    ("zope public", "zpl", r"zope public licen[sc]e", 92),
    ("q public", "qpl", r"q public licen[sc]e", 88),
    ("ibm public", "ipl", r"ibm public licen[sc]e", 90),
    ("open data commons", "odc", r"open data commons (?:attribution|open database|public domain dedication)(?: and)? licen[sc]e", 92),
    ("community data licen", "cdla", r"community data licen[sc]e agreement (?:permissive|sharing)", 92),
    ("openrail", "openrail", r"(?:bigscience )?(?:creativeml )?openrail(?: m| s)?(?: licen[sc]e)?", 88),
    ("no known copyright", "public-domain", r"no known copyright restrictions", 85),
    ("waived all copyright", "cc0", r"has waived all copyright and related or neighbou?ring rights", 95),
    ("to the extent possible under law", "cc0", r"to the extent possible under law the (?:person|author)s? (?:who associated cc0|has dedicated|have dedicated|has waived|have waived)", 92),
    ("creativecommons org publicdomain", "cc0", r"creativecommons org publicdomain zero 1 0", 97),
    ("creativecommons org publicdomain", "public-domain", r"creativecommons org publicdomain mark 1 0", 95),
    ("permission", "permission", r"(?:used|reproduced|reprinted) (?:here )?(?:with|by) (?:kind )?permission", 70),
    ("prior written", "proprietary", r"without (?:the )?(?:express )?prior written (?:permission|consent) of", 75),
    ("trade secret", "proprietary", r"(?:contains|constitutes) (?:valuable )?trade secrets", 75),
    ("personal", "noncommercial", r"for (?:your )?personal (?:and )?non ?commercial use only", 75),
    ("non commercial", "noncommercial", r"(?:for|solely for) non commercial (?:use|purposes)(?: only)?", 70),
    ("noncommercial", "noncommercial", r"(?:for|solely for) noncommercial (?:use|purposes)(?: only)?", 70),
    ("evaluation", "evaluation", r"for evaluation purposes only", 70),
    ("shareware", "shareware", r"this (?:software|program) is shareware", 80),
    ("freeware", "freeware", r"this (?:software|program) is freeware", 80),
    ("dual licensed", "dual", r"dual licensed under", 70),
    ("crown copyright", "ogl", r"crown copyright", 75),
    ("open government", "ogl", r"open government licen[sc]e(?: v?\d 0)?", 92),
    ("all wrongs reserved", "public-domain", r"all wrongs reserved", 60),
    ("copyright all rights", "reserved", r"copyright all rights reserved", 85),
)


def rules() -> list[Rule]:
    """All signatures in order: versioned names first, then names, then single phrases, base phrases last."""
    found: list[tuple[str, str, str, int]] = []
    any_later = r"(?: only| or (?:any|at your option any|\(?at your option\)? any) later(?: version)?)?"
    for label, keyword, names, versions in FAMILIES:
        for v in versions:
            number = v.replace(" ", ".")
            found.append((keyword, f"{label}-{number}", rf"(?:{names}) (?:version |v )?v?{v}{any_later}", 98))
            if " " not in v and len(label) <= 5:
                found.append((label, f"{label}-{number}", rf"{label}v{v}", 95))
    for letters, spelled in CC_TERMS:
        slug = letters.replace(" ", "-")
        for v in CC_VERSIONS:
            number = v.replace(" ", ".")
            found.append(("cc by", f"cc-{slug}-{number}", rf"cc {letters} {v}", 98))
            found.append(("creative commons", f"cc-{slug}-{number}", rf"creative commons {spelled} {v}(?: international| unported| generic)?", 98))
            found.append(("creativecommons", f"cc-{slug}-{number}", rf"creativecommons org licenses {letters} {v}", 99))
        if letters != "by":
            found.append(("cc by", f"cc-{slug}", rf"cc {letters}", 95))
        found.append(("creative commons", f"cc-{slug}", rf"creative commons {spelled}", 90))
        found.append(("creativecommons", f"cc-{slug}", rf"creativecommons org licenses {letters}", 95))
    for n, words in ((2, "simplified|freebsd|2 clause|two clause"), (3, "new|revised|modified|3 clause|three clause"), (4, "original|4 clause|four clause"), (0, "0 clause|zero clause")):
        found.append(("bsd", f"bsd-{n}-clause", rf"(?:{words}) bsd(?: licen[sc]e)?", 95))
        found.append(("bsd", f"bsd-{n}-clause", rf"bsd (?:{words})(?: licen[sc]e)?", 95))
    for label, keyword, names, _ in FAMILIES:
        for lead, weight in (("licensed under (?:the )?(?:terms of (?:the )?)?", 96), ("released under (?:the )?", 96), ("distributed under (?:the )?(?:terms of (?:the )?)?", 96), ("", 85)):
            found.append((keyword, label, rf"{lead}(?:{names})", weight))
    for name in SPDX:
        words = name.replace("-", " ").replace(".", " ")
        found.append(("spdx", name, rf"spdx licen[sc]e identifier {words}", 99))
        if "." in name and not name.startswith("cc"):
            first = words.split()[0]
            found.append((first, name, words if first in TELLING else rf"{CUE} (?:\S+ ){{0,4}}{words}|{words} (?:\S+ ){{0,3}}{CUE}", 95))
    for name in SHORT:
        found.append(("license|licence", name, rf"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}|licen[sc]es? (?:is |are |type )?(?:the )?{name}", 85))
    found += SINGLE
    found += [(phrase, label, phrase, 80) for phrase, label in BASE]
    return [Rule(i, tuple(k.split("|")), label, p, w) for i, (k, label, p, w) in enumerate(found)]


def line_of(text: Column) -> Column:
    """The words in lower case (A-Z only) with one blank before, between and after; one blank for none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), GAP, " ")


def words_in(line: Column) -> Column:
    """The number of words of a line with blanks around."""
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) - 1).cast("bigint")


#: Elements that are folded over at a time: an array that grows is copied at each step, so none grows beyond this.
BLOCK = 256


def once(x: Column, f) -> Column:
    """f of a value that is computed once, as the variable of a lambda, however often f looks at it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def before_each(items: Column, kind: str, value, zero: Column, join) -> Column:
    """(item, before) of an array of the SQL type ``kind``: before joins the values of all items ahead, from zero on. Linear in the array, but for a block."""

    def scan(array: Column, of, first: Column, made: str, shown) -> Column:
        start = F.struct(first.alias("acc"), F.expr(f"cast(array() as array<{made}>)").alias("out"))
        return F.aggregate(array, start, lambda a, x: F.struct(join(a["acc"], of(x)).alias("acc"), F.array_append(a["out"], shown(a["acc"], x)).alias("out")), lambda a: a["out"])

    def cut(all_items: Column) -> Column:
        count = F.size(all_items)
        numbers = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(numbers, lambda i: F.slice(all_items, i * BLOCK + 1, F.lit(BLOCK)))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: join(a, value(x))))
        ahead = scan(totals, lambda t: t, zero, "bigint", lambda acc, t: acc)
        return F.flatten(F.zip_with(blocks, ahead, lambda b, first: scan(b, value, first, f"struct<item:{kind},before:bigint>", lambda acc, x: F.struct(x.alias("item"), acc.alias("before")))))

    return once(once(items, cut), joined)


def starts_of(line: Column, pattern: Column) -> Column:
    """(start, end) in words of each place of a pattern, leftmost first and not overlapping. Whole words: a blank stands before and after."""
    whole = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    before = once(F.split(line, whole), lambda parts: F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), _blanks))
    taken = F.transform(F.regexp_extract_all(line, whole, F.lit(0)), _blanks)
    pairs = F.arrays_zip(before.alias("b"), taken.alias("t"))
    placed = before_each(pairs, "struct<b:bigint,t:bigint>", lambda p: p["b"] + p["t"], F.lit(0).cast("bigint"), lambda a, b: a + b)
    return F.transform(placed, lambda p: F.struct((p["before"] + p["item"]["b"]).alias("start"), (p["before"] + p["item"]["b"] + p["item"]["t"]).alias("end")))


def _blanks(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("bigint")


def scan_licenses(docs: DataFrame, text: str = "text", extra: list[Rule] | None = None) -> DataFrame:
    """The columns of ``docs`` with n_words, base (places of base phrases: label, start, end), detections (label, start, end, priority, weight) and score.

    Places are in words from 0, ends exclusive. Base places are all reported, whatever else covers them. Detections are
    those left after suppression, by start. score is the greatest weight of these over 100, 0 without any. Null and empty
    texts have no words and no detections. Rows are never dropped; columns with the names of new ones are replaced.
    """
    new = ("n_words", "base", "detections", "score")
    all_rules = rules() + (extra or [])
    table = F.array(*[F.struct(F.lit(r.priority).alias("priority"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.weight).alias("weight")) for r in all_rules])
    keywords = sorted({k for r in all_rules for k in r.keywords})
    keep = [c for c in docs.columns if c not in new]
    held, keys = free_name("_line", docs.columns), free_name("_keys", docs.columns)
    lined = docs.select(*keep, line_of(F.col(text)).alias(held))
    found = lined.withColumn(keys, F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col(held), k)))
    places = lambda label, pattern, line: F.transform(starts_of(line, pattern), lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    some, line = F.size(keys) > 0, F.col(held)
    base = F.concat(*[F.when(F.contains(line, F.lit(f" {phrase} ")), places(label, F.lit(phrase), line)).otherwise(F.expr("cast(array() as array<struct<label:string,start:bigint,end:bigint>>)")) for phrase, label in BASE])
    gated = F.filter(table, lambda r: F.arrays_overlap(F.col(keys), r["keywords"]))
    hits = F.flatten(F.transform(gated, lambda r: F.transform(starts_of(line, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))))
    # by start, longer first, then priority: a hit is covered if one before it ends as late
    ordered = before_each(F.array_sort(hits), "struct<start:bigint,back:bigint,priority:int,label:string,weight:int>", lambda h: -h["back"], F.lit(-1).cast("bigint"), F.greatest)
    kept = F.transform(F.filter(ordered, lambda o: -o["item"]["back"] > o["before"]), lambda o: F.struct(o["item"]["label"].alias("label"), o["item"]["start"].alias("start"), (-o["item"]["back"]).alias("end"), o["item"]["priority"].alias("priority"), o["item"]["weight"].alias("weight")))
    out = found.select(
        *keep,
        words_in(line).alias("n_words"),
        F.when(some, base).otherwise(F.expr("cast(array() as array<struct<label:string,start:bigint,end:bigint>>)")).alias("base"),
        F.when(some, kept).otherwise(F.expr("cast(array() as array<struct<label:string,start:bigint,end:bigint,priority:int,weight:int>>)")).alias("detections"),
    )
    return out.withColumn("score", F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0)) / 100.0)


def license_digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts and first and last places of base phrases, and the labels."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, more = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    starts = F.transform("base", lambda b: b["start"])
    return scanned.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, more)).alias("labels"),
        "score",
    )
