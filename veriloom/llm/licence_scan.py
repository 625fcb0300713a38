"""Licence scans: whole texts, paragraphs and lines are normalised and joined by digest to known licences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Public licence texts and the usual sentences that name a licence.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "MIT License\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)

#: Spellings that count as one.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("organisation", "organization"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"))


def normal_line(line) -> F.Column:
    """Lower case, ASCII punctuation and blanks as one blank, one spelling; a copyright line becomes empty."""
    text = F.regexp_replace(F.concat(F.lit(" "), ascii_lower(line), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.regexp_replace(F.trim(text), r"^(c |© |copyright (c|©|[0-9])).*$", "")


def units(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, unit, digest) of each document's text, paragraphs and lines, as far as they hold anything."""
    gap = "\x01"  # stands for a blank line; normal lines hold no control characters
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(x.rlike(r"^[ \t\r]*$"), F.lit(gap)).otherwise(normal_line(x)))
    docs = docs.select("doc_id", lines.alias("lines"))  # normalised once; everything below works on this column
    held = F.filter("lines", lambda x: x != "")
    joined = lambda x: F.array_join(F.filter(F.split(x, "\n"), lambda y: y != ""), " ")
    unit = lambda name: lambda x: F.struct(F.lit(name).alias("unit"), x.alias("x"))
    whole = F.array_join(F.filter(held, lambda x: x != gap), " ")
    paragraphs = F.transform(F.split(F.array_join(held, "\n"), gap), lambda p: unit("paragraph")(joined(p)))
    everything = F.concat(F.array(unit("text")(whole)), paragraphs, F.transform(F.filter(held, lambda x: x != gap), unit("line")))
    # Never empty; explode() would have Spark test its size in a filter below, and so normalise every line again.
    rows = docs.select("doc_id", F.explode_outer(everything).alias("u")).where("u.x <> ''")
    return rows.select("doc_id", F.col("u.unit").alias("unit"), F.sha2(F.col("u.x").cast("binary"), 256).alias("digest"))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """Rows (licence, digest), normalised in the same way; as many as the licences listed."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "doc_id long, licence string, text string")
    digests = units(rows).where("unit = 'text'").select("doc_id", "digest")
    return rows.join(digests, "doc_id").select("licence", "digest").distinct()


def licences(docs: DataFrame, known=KNOWN) -> DataFrame:
    """Rows (doc_id, licence, unit, matches): how many of a document's units are, as a whole, the text of a known licence.

    unit is text, paragraph or line; a text of one line counts as all three. Null and blank texts match nothing; repeated rows are counted together;
    other columns are ignored; a row with a null id has a null doc_id in the result. The known licences are configuration, and broadcast.
    """
    found = units(docs).join(F.broadcast(known_digests(docs.sparkSession, known)), "digest")
    return found.groupBy("doc_id", "licence", "unit").agg(F.count("*").alias("matches"))
