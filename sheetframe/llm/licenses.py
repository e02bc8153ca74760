"""Licence texts found by the digest of their canonical form. DataFrame operations only.

Known texts and corpus texts go through one canonical form: lower case, no lines of copyright, punctuation and white
space as single spaces, equivalent spellings as one. Entire units - the whole text, each block between empty lines,
each line - are then hashed and joined with the known digests. The known table is fixed and small.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence texts (fixed values): short full texts and the usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
KNOWN = (
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the 2-clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", ISC),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", MPL_NOTICE),
)
#: Equivalent spellings (fixed values): over canonical text, as whole words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("ver", "version"), ("v", "version"), ("https", "http"),
    ("organisation", "organization"), ("non infringement", "noninfringement"), ("share alike", "sharealike"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"),
)
#: A line of copyright, in lower case.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"
#: Spelling changes leave at least an eighth of the letters and digits, so a unit with more than eight times those of the longest known text can't match.
SHRINK = 8


def folded(text: Column) -> Column:
    """Lower case without lines of copyright; runs of other than letters, digits and line ends are one space."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "\r\n?", "\n"), COPYRIGHT_LINE, "")
    return F.regexp_replace(low, NOT_WORD, " ")


def spelled(unit: Column) -> Column:
    """The canonical form of a folded unit: single spaces, one spelling."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(unit, r"[ \n]+", " ")), F.lit(" "))
    return F.trim(reduce(lambda c, s: F.replace(c, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), SPELLINGS, words))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark, known=KNOWN) -> DataFrame:
    """license, digest and the length of the canonical text, for a fixed table of texts."""
    canonical = spelled(folded(F.col("t")))
    return spark.createDataFrame(list(known), "license string, t string").select("license", digest(canonical).alias("digest"), F.length(canonical).alias("size")).where("size > 0").dropDuplicates(["license", "digest"])


def first_words(known=KNOWN) -> list[str]:
    """All words that a folded unit can begin with if its canonical form is that of a known text."""
    import regex

    out = set()
    for _, text in known:
        words = regex.findall(r"[\p{L}\p{N}]+", regex.sub(COPYRIGHT_LINE, "", text.lower()))
        begin = reduce(lambda t, s: t.replace(f" {s[0]} ", f" {s[1]} "), SPELLINGS, f" {' '.join(words)} ").split()
        out |= set(begin[:1])
    size = 0
    while size < len(out):
        size = len(out)
        out |= {a.split()[0] for a, b in SPELLINGS if b.split()[0] in out}
    return sorted(out)


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """KNOWN, and the usual full texts with their variants: with a title, as one list or with space between its items, without what follows the terms."""
    out = list(KNOWN)
    texts = [(p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]
    # In these, the items of the list stand apart in some copies and close together in others.
    texts += [(n, re.sub(r"\n(?=[0-9]\. )", "\n\n", t)) for n, t in texts if n.startswith("BSD-")]
    texts += [(n, t.replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS")) for n, t in texts if n.startswith("BSD-")]
    texts += [(n, re.sub(r"(?m)^[0-9]\. ", "* ", t)) for n, t in texts if n.startswith("BSD-")]
    for name, text in texts:
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        out += [(name, text)] + ([(name, text[: end.end()]), (name, text[: end.start()])] if end else [])
    titles = {"MIT": ("MIT License", "MIT License (MIT)"), "ISC": ("ISC License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "Zlib": ("zlib License",)}
    plain = [("MIT", MIT), ("ISC", ISC), *texts]
    return (*out, *((name, f"{title}\n\n{text}") for name, text in plain for title in titles.get(name, ())))


def _blocks(folded_text: Column) -> Column:
    """The stretches between empty lines that have a word."""
    return F.filter(F.split(folded_text, "\n *\n"), lambda x: F.trim(F.translate(x, "\n", " ")) != "")


def _run_lengths(spark, known) -> dict[str, list[int]]:
    """For each word that a known text of several blocks can begin with, how many blocks such texts have."""
    rows = spark.createDataFrame(list(known), "license string, t string").select("license", "t", F.size(_blocks(folded(F.col("t")))).alias("k")).where("k > 1").collect()
    out: dict[str, set[int]] = {}
    for r in rows:
        for word in first_words([(r.license, r.t)]):
            out.setdefault(word, set()).add(r.k)
    return {w: sorted(ks) for w, ks in out.items()}


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", known=KNOWN, runs: bool = False) -> DataFrame:
    """key, license, n_whole, n_blocks, n_lines (long): units of a text that are, entire, a known licence text.

    A unit is the whole text, a block of more than one line between empty lines, or a line; a text of one line is
    counted as whole and as line. With `runs`, so is every run of as many blocks as a known text has, if it is not the
    whole text; it counts among the blocks. Texts without a match, null and empty ones give no row. Null keys are kept;
    repeated rows add up. The known table is a fixed list and is broadcast; nothing of the corpus is shuffled but matches.
    """
    table = known_digests(docs.sparkSession, known)
    limit = SHRINK * max(len(t) for _, t in known)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), folded(F.col(text)).alias("f"))
    lines = F.transform(F.split("f", "\n"), lambda x: F.struct(F.lit("line").alias("scope"), x.alias("u")))
    blocks = F.transform(F.filter(F.split("f", "\n *\n"), lambda x: F.contains(F.trim(x), F.lit("\n"))), lambda x: F.struct(F.lit("block").alias("scope"), x.alias("u")))
    whole = F.array(F.struct(F.lit("whole").alias("scope"), F.col("f").alias("u")))
    scopes = [whole, blocks, lines]
    lengths = _run_lengths(docs.sparkSession, known) if runs else {}
    if lengths:
        rows = rows.select("_key", "f", _blocks(F.col("f")).alias("bl"))
        of_word = F.create_map(*(c for w, ks in lengths.items() for c in (F.lit(w), F.array(*map(F.lit, ks)))))
        starts = F.filter(F.transform("bl", lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, r"^[ \n]*([^ \n]*)", 1).alias("w"))), lambda s: s["w"].isin(list(lengths)))
        places = F.flatten(F.transform(starts, lambda s: F.transform(of_word[s["w"]], lambda k: F.struct(s["i"].alias("i"), k.alias("k")))))
        places = F.filter(places, lambda p: (p["i"] + p["k"] <= F.size("bl")) & (p["k"] < F.size("bl")))
        scopes.append(F.transform(places, lambda p: F.struct(F.lit("block").alias("scope"), F.array_join(F.slice("bl", p["i"] + 1, p["k"]), "\n").alias("u"))))
    units = rows.select("_key", F.explode(F.concat(*scopes)).alias("x")).select("_key", "x.scope", F.col("x.u").alias("u"))
    # Units that begin with another word than any spelling of a known text, or have far more letters than all, can't match.
    units = units.where(F.regexp_extract("u", r"^[ \n]*([^ \n]*)", 1).isin(first_words(known)) & (F.length(F.translate("u", " \n", "")) <= limit)).select("_key", "scope", digest(spelled(F.col("u"))).alias("digest"))
    hits = units.join(F.broadcast(table.select("license", "digest")), "digest")
    count = lambda s: F.count(F.when(F.col("scope") == s, 1))
    return hits.groupBy("_key", "license").agg(count("whole").alias("n_whole"), count("block").alias("n_blocks"), count("line").alias("n_lines")).withColumnRenamed("_key", key)
