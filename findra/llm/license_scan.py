"""License scans by sentence rules: normalised sentences become known sentence identifiers, whose sequence is matched against ordered licence rules.

A text is cut into sentences twice: by lines (a notice on a line of its own) and by paragraphs (a
licence text wrapped over lines). Line feeds, carriage returns and both together break lines. Sentences end at ``.``, ``!`` or ``?`` before white space.
Normalising lower-cases A-Z and reduces everything but ASCII letters, digits and non-ASCII characters
to single spaces. Known sentences are joined from a fixed broadcast table; the identifiers of a cut, in
text order, make a sequence in which a rule's identifiers must stand one after another. A longer rule
hides the rules whose identifiers it contains.

Defined results: null and empty texts have no sentences and no licences; repeated rows are each
reported; very long texts are processed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licence sentences by identifier, in any case and punctuation.
SENTENCES = {
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "MIT License", "The MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-permission": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-obtain": ["You may obtain a copy of the License at"],
    "apache-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "GNU General Public License, version 3", "Licensed under the GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl2-ref": ["Licensed under the GNU General Public License, version 2", "GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl-ref": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd3-ref": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0-ref": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "mpl-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "rights-reserved": ["All rights reserved"],
}

#: Licence rules as ordered sentence identifiers.
RULES = {
    "apache-2.0": [["apache-ref", "apache-obtain", "apache-url", "apache-warranty"], ["apache-ref", "apache-copy", "apache-warranty"], ["apache-ref"]],
    "bsd-3-clause": [["bsd3-ref", "bsd-grant"], ["bsd3-ref"]],
    "bsd": [["bsd-grant"]],
    "cc-by-4.0": [["cc-by-ref"]],
    "cc-by-nc-4.0": [["cc-by-nc-ref"]],
    "cc-by-sa-4.0": [["cc-by-sa-ref"]],
    "cc0-1.0": [["cc0-ref"]],
    "gpl-2.0": [["gpl2-ref"]],
    "gpl-3.0": [["gpl3-ref"]],
    "gpl-3.0-or-later": [["gpl3-later", "gpl-warranty"], ["gpl3-later"]],
    "lgpl-3.0": [["lgpl-ref"]],
    "mit": [["mit-ref", "mit-permission", "mit-notice", "mit-warranty"], ["mit-permission", "mit-notice", "mit-warranty"], ["mit-ref", "mit-grant", "mit-warranty"], ["mit-grant", "mit-warranty"], ["mit-ref"]],
    "mpl-2.0": [["mpl-ref"]],
    "proprietary": [["rights-reserved"]],
}

_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_PUNCT = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def normalised(sentence: str) -> str:
    """The form in which sentences are compared."""
    plain = sentence.translate(str.maketrans(_UPPER + _PUNCT, _UPPER.lower() + " " * len(_PUNCT)))
    return " ".join(x for x in plain.split(" ") if x)


def known_sentences(spark: SparkSession) -> DataFrame:
    """The fixed table ``sentence, ident``."""
    rows = sorted({(normalised(s), k) for k, group in SENTENCES.items() for s in group})
    values = ", ".join(f"('{s}', '{k}')" for s, k in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(sentence, ident)")


def _sentences(text: Column) -> Column:
    """Both cuts of a text as ``cut, at, raw``, the sentences still to be normalised."""

    def cut(k: int):
        return lambda s, i: F.struct(F.lit(k).alias("cut"), i.alias("at"), s.alias("raw"))

    text = F.replace(F.translate(text, "\u0001", " "), F.lit("\r\n"), F.lit("\n"))
    text = F.replace(text, F.lit("\r"), F.lit("\n"))
    marked = F.regexp_replace(text, "([.!?])[ \\t]+", "$1\n")
    unwrapped = F.regexp_replace(F.regexp_replace(text, "\n[ \\t]*\n", "\u0001"), "\n", " ")
    cuts = [F.split(marked, "\n", -1), F.split(F.regexp_replace(unwrapped, "([.!?]) +", "$1\u0001"), "\u0001", -1)]
    return F.concat(*[F.transform(c, cut(k)) for k, c in enumerate(cuts)])


def _normalised(sentence: Column) -> Column:
    plain = F.translate(sentence, _UPPER + _PUNCT, _UPPER.lower() + " " * len(_PUNCT))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def _rule_patterns() -> list[tuple[str, list[str]]]:
    """Licence and pattern of each way, longer ways first."""
    ways = [(name, way) for name, group in RULES.items() for way in group]
    return sorted(ways, key=lambda x: (-len(x[1]), x[0]))


def _matched(sequence: Column) -> Column:
    """Licences whose rule stands in the identifier sequence ``|a||b|``.

    Matched ways are struck out, so that a shorter way or rule does not match inside them again.
    """
    found, rest = F.array().cast("array<string>"), sequence
    for name, way in _rule_patterns():
        pattern = "".join(f"|{i}|" for i in way)
        if len(way) > 1:
            found = F.concat(found, F.when(F.contains(rest, F.lit(pattern)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
            rest = F.replace(rest, F.lit(pattern), F.lit("|#|"))
    single = {way[0]: name for name, way in _rule_patterns() if len(way) == 1}
    for ident, name in sorted(single.items()):
        found = F.concat(found, F.when(F.contains(rest, F.lit(f"|{ident}|")), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, n_sentences`` (known ones, by the cut that has more), ``idents`` (in text order, of both cuts) and ``licences`` (sorted, distinct)."""
    known = known_sentences(docs.sparkSession)
    # The row number is made and used within one job, only to keep repeated documents apart.
    none = F.array(F.struct(F.lit(-1).alias("cut"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("raw")))
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id), F.concat(none, F.coalesce(_sentences(F.col(text)), F.array())).alias("s"))
    each = each.select("row", doc_id, F.explode("s").alias("s"))
    each = each.select("row", doc_id, "s.cut", "s.at", _normalised(F.col("s.raw")).alias("sentence"))
    hits = each.join(F.broadcast(known), "sentence", "left").where(F.col("ident").isNotNull() | (F.col("cut") < 0))
    per = hits.groupBy("row", doc_id).agg(F.array_sort(F.collect_list(F.when(F.col("ident").isNotNull(), F.struct("cut", "at", "ident")))).alias("seq"))

    def of(cut: int) -> Column:
        # One parameter: Spark hands an element's position to a second one, even one with a default.
        return F.filter("seq", lambda s: s["cut"] == cut)

    def sequence(cut: int) -> Column:
        return F.array_join(F.transform(of(cut), lambda s: F.concat(F.lit("|"), s["ident"], F.lit("|"))), "")

    per = per.withColumns({"a": sequence(0), "b": sequence(1)})
    licences = F.array_sort(F.array_union(_matched(F.col("a")), _matched(F.col("b"))))
    return per.select(doc_id, F.greatest(F.size(of(0)), F.size(of(1))).cast("bigint").alias("n_sentences"), F.concat("a", F.lit("/"), "b").alias("idents"), licences.alias("licences"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    values = ", ".join(f"('{s}', '{k}')" for s, k in sorted({(normalised(s), k) for k, group in SENTENCES.items() for s in group}))
    plain = f"trim(regexp_replace(translate(s, '{_UPPER}' || chr(1) || {' || '.join(f'chr({ord(c)})' for c in _PUNCT if c not in chr(0) + chr(1))}, '{_UPPER.lower()}' || '{' ' * (len(_PUNCT) - 1)}'), ' +', ' ', 'g'))"
    ways = _rule_patterns()
    several = [w for w in ways if len(w[1]) > 1]
    struck, conditions = "seq", []
    for name, way in several:
        pattern = "".join(f"|{i}|" for i in way)
        conditions.append((name, f"contains({struck}, '{pattern}')"))
        struck = f"replace({struck}, '{pattern}', '|#|')"
    conditions += [(name, f"contains({struck}, '|{way[0]}|')") for name, way in ways if len(way) == 1]
    matched = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS licence FROM q WHERE {c}" for name, c in conditions)
    cut1 = "string_split(regexp_replace(regexp_replace(regexp_replace(text, '\\n[ \\t]*\\n', chr(1), 'g'), '\\n', ' ', 'g'), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"
    cut0 = "string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))"
    return f"""
WITH k(sentence, ident) AS (VALUES {values}),
c AS (SELECT doc_id, 0 AS cut, {cut0} AS a FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1, {cut1} FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, cut, generate_subscripts(a, 1) AS p, unnest(a) AS s FROM c),
h AS (SELECT doc_id, cut, p, ident FROM (SELECT doc_id, cut, p, {plain} AS sentence FROM e) JOIN k USING (sentence)),
q AS (SELECT doc_id, cut, string_agg('|' || ident || '|', '' ORDER BY p, ident) AS seq FROM h GROUP BY doc_id, cut),
m AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM (SELECT DISTINCT doc_id, licence FROM ({matched})) GROUP BY doc_id),
n AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, cut, count(*) AS n FROM h GROUP BY doc_id, cut) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_sentences, coalesce(licences, '') AS licences FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


OP5_SQL = _sql()
