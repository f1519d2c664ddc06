"""Licence texts by canonical digests.

A text is normalised: lower case, copyright lines dropped, equivalent spellings replaced by one,
everything but letters and digits read as one blank. The SHA-256 digest of the result is joined to
the digests of the known texts, both for a document as a whole and for each of its lines. The table
of known digests is fixed in size, so it is sent to all tasks.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short licences and notices, by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]
# Spellings that are read as the second one.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("organisation", "organization"),
             ("whilst", "while"), ("wilful", "willful"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder")]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
SEPARATORS = r"[^a-z0-9\x{0080}-\x{10FFFF}]+"


def normalised(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, SEPARATORS, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def known_digests(known=KNOWN) -> list[tuple[str, str]]:
    """(digest, identifier) of the known texts."""
    out = {}
    for name, text in known:
        text = re.sub(COPYRIGHT_LINE, "", text.lower())
        text = re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", text).strip(" ")
        for a, b in SPELLINGS:
            text = text.replace(a, b)
        out[hashlib.sha256(text.encode()).hexdigest()] = name
    return sorted(out.items())


def scan(docs: DataFrame, known=KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license_id, whole, n_lines): licences that a text is, or has as lines.

    `whole` tells that the text as a whole is the licence, n_lines how many of its lines are.
    Null and empty texts have none. Repeated rows give repeated results, also without doc_id. An
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(known_digests(known), "digest string, license_id string"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    # The digests of a row stay together, so that equal rows are not mixed.
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(digest(x).alias("digest"), F.lit(False).alias("whole")))
    units = rows.select("doc_id", "_row", F.explode(F.concat(F.array(F.struct(digest(F.col("text")).alias("digest"), F.lit(True).alias("whole"))), lines)).alias("unit"))
    hits = units.select("doc_id", "_row", "unit.*").join(table, "digest")
    return hits.groupBy("_row", "doc_id", "license_id").agg(
        F.max("whole").alias("whole"), F.count_if(~F.col("whole")).alias("n_lines")).drop("_row")


def oracle_sql(known=KNOWN) -> str:
    """The same in DuckDB over `documents`."""
    def norm(x: str) -> str:
        x = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g')"
        x = f"trim(regexp_replace({x}, '{SEPARATORS}', ' ', 'g'), ' ')"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"sha256({x})"

    values = ", ".join(f"('{d}', '{name}')" for d, name in known_digests(known))
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (SELECT r, doc_id, {norm('text')} AS digest, true AS whole FROM docs
  UNION ALL SELECT r, doc_id, {norm('line')}, false FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line FROM docs))
SELECT doc_id, license_id, bool_or(whole) AS whole, count(*) FILTER (WHERE NOT whole) AS n_lines
FROM units JOIN known USING (digest) GROUP BY r, doc_id, license_id"""
