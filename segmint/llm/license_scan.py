"""Licence scan by sentence rules (DataFrame functions only).

A text is cut into sentences, each normalised (ASCII lower case, every run of
other characters than a-z and 0-9 one space). Normalised sentences that are
known get the identifier of the licence sentence: an equi-join on their first
three words with the small sentence table, then the sentence's whole pattern.
The identifiers of a document, in text order, are matched against ordered
licence rules: a rule holds where its identifiers follow one another in the
sequence. A rule that is part of a longer rule that holds is not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, normalised; "(.*)"
# stands for names, years and titles.
SENTENCES: dict[str, str] = {
    "apache2_notice": "licensed under the apache license version 2 0(.*)",
    "apache2_obtain": "you may obtain a copy of the license at(.*)",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_notice": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_may": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of (.*) may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl2_notice": "this work is licensed under the gnu general public license version 2",
    "gpl_this_free": "this program is free software",
    "gpl2_or_later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3_or_later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_see": "see the gnu general public license for more details",
    "mpl2_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc_by_nc4": "licensed under cc by nc 4 0",
    "cc_by4": "licensed under cc by 4 0",
    "cc_by_sa4": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "all_rights": "all rights reserved",
}

# Licence -> its sentences in order.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2_notice"]),
    ("Apache-2.0", ["apache2_notice", "apache2_comply", "apache2_obtain"]),
    ("Apache-2.0", ["apache2_notice", "apache2_comply", "apache2_obtain", "apache2_as_is", "apache2_see"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_licensed"]),
    ("MIT", ["mit_grant", "mit_include", "mit_as_is"]),
    ("ISC", ["isc_grant"]),
    ("BSD-2-Clause", ["bsd_may", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["bsd_may", "bsd_source", "bsd_binary", "bsd_names"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("GPL-2.0-only", ["gpl2_notice"]),
    ("GPL-2.0-or-later", ["gpl_this_free", "gpl2_or_later"]),
    ("GPL-2.0-or-later", ["gpl_this_free", "gpl2_or_later", "gpl_hope", "gpl_see"]),
    ("GPL-3.0-or-later", ["gpl_this_free", "gpl3_or_later"]),
    ("GPL-3.0-or-later", ["gpl_this_free", "gpl3_or_later", "gpl_hope", "gpl_see"]),
    ("MPL-2.0", ["mpl2_subject"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4"]),
    ("CC-BY-4.0", ["cc_by4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa4"]),
    ("CC0-1.0", ["cc0"]),
    ("All-rights-reserved", ["all_rights"]),
]

# Notices with a free beginning and end, (three fixed words that
# occur in it, pattern of what must occur), by the sentence's identifier; and
# their rules.
NOTICES: dict[str, tuple[str, str]] = {}
NOTICE_RULES: list[tuple[str, list[str]]] = []


def _notice(key: str, name: str, head: str, phrase: str) -> None:
    NOTICES[key] = (head, f"^(.* )?{phrase}( .*)?$")
    NOTICE_RULES.append((name, [key]))


UNDER = "under (the )?((terms|conditions|terms and conditions) of )?(the )?"
for _key, _name, _head, _words in [
    ("mit", "MIT", "mit license", "mit license"),
    ("apache2", "Apache-2.0", "apache license", "apache (software )?license (version |v)?2( 0)?"),
    ("apache2_short", "Apache-2.0", "apache 2 0", "apache 2 0"),
    ("isc", "ISC", "isc license", "isc license"),
    ("bsd2", "BSD-2-Clause", "bsd 2 clause", "bsd 2 clause"),
    ("bsd3", "BSD-3-Clause", "bsd 3 clause", "bsd 3 clause"),
    ("mpl2", "MPL-2.0", "mozilla public license", "mozilla public license (version |v )?2 0"),
    ("epl2", "EPL-2.0", "eclipse public license", "eclipse public license (version |v )?2 0"),
    ("unlicense", "Unlicense", "the unlicense", "unlicense"),
    *((f"cc_{k.lower().replace('-', '_')}4", f"CC-{k}-4.0", " ".join(f"cc {k.lower().replace('-', ' ')}".split()[:3]), f"cc {k.lower().replace('-', ' ')} 4 0") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    ("cc0", "CC0-1.0", "cc0 1 0", "cc0 1 0"),
]:
    _notice(f"{_key}_under", _name, _head, UNDER + _words)

LATER = "( of the license)? or (at your option )?(any )?later( version)?"
for _key, _words, _versions in [("gpl", "general", "23"), ("lgpl", "lesser general", "3"), ("lgpl", "lesser general", "2 1"), ("agpl", "affero general", "3")]:
    for _v in [_versions] if " " in _versions else _versions:
        _name = f"{_key.upper()}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"
        _full = f"gnu {_words} public license( as published by the free software foundation)?( either)? (version |v)?{_v}( 0)?"
        _id = f"{_key}{_v.replace(' ', '')}"
        _notice(f"{_id}_later", f"{_name}-or-later", f"gnu {_words}", UNDER + _full + LATER)
        _notice(f"{_id}_only", f"{_name}-only", f"gnu {_words}", UNDER + _full + f"(?!{LATER})(?! [0-9])")
        # the version in a sentence of its own, below "...Free Software Foundation;"
        NOTICES[f"{_id}_either"] = (f"version {_v} of" if " " not in _v else "version 2 1", f"^either version {_v}{LATER}$")
        NOTICE_RULES.append((f"{_name}-or-later", [f"{_key}_terms", f"{_id}_either"]))
    NOTICES[f"{_key}_terms"] = (f"gnu {_words}", f"^(.* )?{UNDER}gnu {_words} public license as published by the free software foundation$")

SPDX = ["MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0"]
SPDX += [f"CC-{k}-4.0" for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")]
SPDX += [f"{k}-{x}" for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for x in ("only", "or-later")]
for _name in SPDX:
    _words = " ".join(_name.lower().replace("-", " ").replace(".", " ").split())
    _words = _words.replace(" only", "( only)?")  # the older identifiers have no ending
    NOTICES["spdx_" + _name.lower().replace("-", "_").replace(".", "_")] = ("spdx license identifier", f"^spdx license identifier (.* (or|and) )?{_words}( (or|and|with) (?!later).*)?$")
    NOTICE_RULES.append((_name, ["spdx_" + _name.lower().replace("-", "_").replace(".", "_")]))

#: Sentences with one of these are looked up by every place, not only the first.
ANCHOR = "licen[cs]e|cc0|cc by|apache 2|bsd [23]|either version"
#: Lines of white space and comment marks only are empty lines.
MARKS = "[ \\t\\r#*/;%!<>=|-]*"
BREAK = "\x01"
HEAD_WORDS = 3


def normalise(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, pos, piece, sentence): normalised sentences in text order.

    A sentence ends at one of .!?;: before white space, or at a line that is
    empty or has only comment marks. An SPDX line is a sentence of its own.
    One that runs over several lines is also offered line by line (piece 1,
    2...), for notices below a line that has no full stop."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spdx = F.regexp_replace(t, "(?i)(SPDX-License-Identifier:[^\\n+]*[0-9])\\+", "$1-or-later")
    spdx = F.regexp_replace(spdx, "(?i)(SPDX-License-Identifier):[ \\t]*([^\\n]*)", BREAK + "$1 $2" + BREAK)
    t = F.when(F.contains(F.lower(t), F.lit("spdx-license-identifier:")), spdx).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, f"\\n(?:{MARKS}\\n)+", BREAK), "([.!?;:])[ \\t\\r\\n]+", "$1" + BREAK)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), t.alias("t"))
    raw = rows.select("doc_id", "row", F.posexplode(F.split("t", BREAK, -1)).alias("pos", "raw"))
    pieces = F.when(F.contains("raw", F.lit("\n")), F.concat(F.array("raw"), F.split("raw", "\n", -1))).otherwise(F.array("raw"))
    return raw.select("doc_id", "row", "pos", F.posexplode(pieces).alias("piece", "raw")).select("doc_id", "row", "pos", "piece", normalise(F.col("raw")).alias("sentence"))


def known_sentences(sentences: DataFrame, table: dict[str, str] | None = None, notices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, pos, piece, sentence_id): the sentences that are known. The
    tables have a fixed size, so they are broadcast and only hits go on. Each
    pattern of ``table`` must begin with at least three fixed words; those of
    ``notices`` are found by two or three fixed words anywhere. Where a sentence
    (or a line of it) is known as a whole, its notices are not reported."""
    notices = (NOTICES if table is None else {}) if notices is None else notices
    table = SENTENCES if table is None else table
    short = [k for k, p in table.items() if len(p.split("(.*)")[0].split()) < HEAD_WORDS]
    if short:
        raise ValueError(f"patterns must begin with {HEAD_WORDS} fixed words: {short}")
    fixed = [(k, " ".join(p.split()[:HEAD_WORDS]), f"^{p}$", True) for k, p in table.items()]
    fixed += [(k, head, p, False) for k, (head, p) in notices.items()]
    known = sentences.sparkSession.createDataFrame(fixed, "sentence_id string, head string, pattern string, whole boolean")
    words = F.split("sentence", " ")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    head = F.array(F.substring_index("sentence", " ", HEAD_WORDS))
    every = F.array_distinct(F.concat(head, F.when(F.size(words) >= 3, F.concat(runs(2), runs(3))).otherwise(F.array().cast("array<string>"))))
    heads = F.when(F.regexp_like("sentence", F.lit(ANCHOR)), every).otherwise(head) if notices else head
    keyed = sentences.withColumn("head", F.explode(heads))
    hits = keyed.join(F.broadcast(known), "head").where(F.regexp_like("sentence", F.col("pattern")))
    one = hits.groupBy("doc_id", "row", "pos").agg(F.collect_set(F.struct("whole", "piece", "sentence_id")).alias("s"))
    whole = F.filter("s", lambda x: x["whole"])
    # a notice within one line is also one of the sentence that has the line
    least = F.filter("s", lambda x: ~F.exists("s", lambda y: (y["sentence_id"] == x["sentence_id"]) & (y["piece"] > x["piece"]) & (x["piece"] == 0)))
    return one.select("doc_id", "pos", F.explode(F.when(F.size(whole) > 0, whole).otherwise(least)).alias("x")).select("doc_id", "pos", "x.piece", "x.sentence_id")


def match_rules(known: DataFrame, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per document with a known sentence: doc_id, n_sentences,
    sentence_ids (comma-joined, in text order) and licenses (names of the
    rules that hold, sorted, comma-joined; empty if none)."""
    rules = [*RULES, *NOTICE_RULES] if rules is None else rules
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece", "sentence_id")))
    seq = known.groupBy("doc_id").agg(ordered.alias("s"))
    seq = seq.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join(F.transform("s", lambda x: x["sentence_id"]), ",").alias("sentence_ids"))
    whole = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    holds = []
    for name, ids in rules:
        own = f",{','.join(ids)},"
        longer = [f",{','.join(o)}," for _, o in rules if own != f",{','.join(o)}," and own in f",{','.join(o)},"]
        ok = F.contains(whole, F.lit(own))
        for x in longer:
            ok = ok & ~F.contains(whole, F.lit(x))
        holds.append(F.when(ok, F.lit(name)))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*holds))))
    return seq.withColumn("licenses", F.array_join(names, ","))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of each document that has a known licence sentence.

    Null and empty texts have no sentences. Rows that share an id (or have
    none) are scanned as one document. Nothing but hits is shuffled, so a
    very common notice costs one small row a document."""
    return match_rules(known_sentences(sentence_rows(docs, id_col, text)))
