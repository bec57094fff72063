"""License scans by diagonal voting: rolling word k-gram hashes are joined to template positions and vote for their
offset diagonal (document position - template position); neighbouring diagonals merge into one span, which is verified
by the longest common subsequence of the template and the words its hits cover. Words put in or left out move the
diagonal by their number, so diagonals are neighbours up to half a template, at most ``GAP`` words, apart. A span is not
reported if at each of its words a span of another label holds more of its own template. Only built-in expressions.

Words are runs of ASCII letters and digits and of all other characters than ASCII, A-Z lower-cased. Defined results:
null text is empty; a null doc_id has its own base result, but no spans; rows that share a doc_id share the labels
found in any; an empty table gives no rows. A text with any number of notices costs no more than its length.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import NON_ALNUM, grams_of, id_and_text, lower_ascii, words_of

# fixed values: base phrases and labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: usual notices, then whole texts; (label, text). A bounded constant, so its k-grams are broadcast.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
               "with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""),
)
GRAM = 3
NEIGHBOURS = 2  # diagonals this far apart are one span in the shortest templates
GAP = 12  # and in the longest
BITS = 62  # template places in one long of a mask
VERIFIED = 75  # percent of a template's words that its span must hold in order


def scan_words(text: Column) -> Column:
    return words_of(lower_ascii(text), NON_ALNUM)


def _places(phrase: str) -> Column:
    """Starts of a phrase's words in the array ``words``; arrays without its first word are not searched."""
    parts = phrase.split()
    hit = F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), lambda i: reduce(
        lambda a, b: a & b, [F.get("words", i + j) == F.lit(p) for j, p in enumerate(parts)]))
    return F.when((F.size("words") >= len(parts)) & F.array_contains("words", parts[-1]), hit).otherwise(
        F.array().cast("array<int>"))


def base_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, labels (array) of the base phrases."""
    places = id_and_text(docs).select("doc_id", scan_words(F.col("text")).alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        *[_places(p).alias(f"p{i}") for i, p in enumerate(BASE)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(BASE.values())]))
    return places.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
                         F.array_min(every).cast("long").alias("first_word"),
                         F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))


def template_words(phrase: str) -> list[str]:
    return re.findall("[a-z0-9]+", phrase.lower())


def _masks(words: list[str]) -> list[list[int]]:
    """For each word of a template, the places of that word as bits of longs."""
    return [[sum(1 << (i - a) for i, w in enumerate(words) if w == word and a <= i < a + BITS)
             for a in range(0, len(words), BITS)] for word in words]


def _covered(hits: Column, masks: Column, k: int) -> Column:
    """Document places and word masks under the k-grams of ``hits`` (at, t_at), each place once, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.array(*[
        F.struct((h["at"] + j).alias("at"), F.get(masks, h["t_at"] + j).alias("mask")) for j in range(k)])))))


def _in_order(covered: Column, size: Column) -> Column:
    """Longest common subsequence of a template of ``size`` words and the covered words: the zero bits that are left
    when each word's mask is added to the row of bits, carried from long to long."""
    ones = F.lit((1 << BITS) - 1).cast("long")
    limbs = F.ceil(size / BITS).cast("int")
    start = F.struct(F.array_repeat(ones, 0).alias("bits"), F.lit(0).cast("long").alias("carry"))

    def word(row: Column, mask: Column) -> Column:
        def limb(done: Column, i: Column) -> Column:
            v, m = F.get(row, i), F.get(mask, i)
            total = v + v.bitwiseAND(m) + done["carry"]
            return F.struct(F.concat(done["bits"], F.array(total.bitwiseOR(v - v.bitwiseAND(m)).bitwiseAND(ones))).alias("bits"),
                            F.shiftright(total, BITS).alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), limbs - 1), start, limb, lambda done: done["bits"])

    left = F.aggregate(covered, F.array_repeat(ones, limbs), lambda row, c: word(row, c["mask"]))
    # bits beyond the template are in no mask and stay ones
    return (limbs * BITS - F.aggregate(left, F.lit(0), lambda n, v: n + F.bit_count(v))).cast("int")


def find_spans(docs: DataFrame, k: int = GRAM) -> DataFrame:
    """doc_id, template, label, start, end (words), share: verified spans."""
    spark = docs.sparkSession
    given = spark.createDataFrame(
        [(i, label, words, _masks(words)) for i, (label, text) in enumerate(TEMPLATES) for words in [template_words(text)]],
        "template int, label string, wanted array<string>, masks array<array<bigint>>")
    grams = given.select("template", F.posexplode(grams_of(F.col("wanted"), k)).alias("t_at", "gram"))
    texts = id_and_text(docs).where("doc_id IS NOT NULL").withColumn("version", F.xxhash64("text"))
    hits = (texts.select("doc_id", "version", F.posexplode(grams_of(scan_words(F.col("text")), k)).alias("at", "gram"))
            .join(F.broadcast(grams), "gram"))
    key = ["doc_id", "version", "template"]
    votes = hits.groupBy(*key, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.collect_set(F.struct("at", "t_at")).alias("hits"))
    sizes = F.broadcast(given.select("template", "label", "masks", F.size("masks").alias("size")))
    near = F.greatest(F.lit(NEIGHBOURS), F.least(F.lit(GAP), F.floor(F.col("size") / 2)))
    order = Window.partitionBy(*key).orderBy("diagonal")
    merged = (votes.join(sizes.select("template", "size"), "template")
              .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"), F.lit(1)))
              .withColumn("span", F.sum("new").over(order))
              .groupBy(*key, "span").agg(F.flatten(F.collect_list("hits")).alias("hits")))
    # what a span can hold at most: each vote is a k-gram, so k words
    likely = merged.join(sizes, "template").where(F.size("hits") * k * 100 >= VERIFIED * F.col("size"))
    held = (likely.withColumn("covered", _covered(F.col("hits"), F.col("masks"), k))
            .withColumn("held", _in_order(F.col("covered"), F.col("size")))
            .where(F.col("held") * 100 >= VERIFIED * F.col("size"))
            .select(*key, "span", "label", "held", (F.col("held") / F.col("size")).alias("share"),
                    F.explode("covered.at").alias("place")))
    # templates are few and bounded, so few spans meet at one word of a text, however many the text holds
    best = F.max(F.struct("held", "share", "label")).over(Window.partitionBy("doc_id", "version", "place"))
    own = (F.col("best.label") == F.col("label")) | (F.struct("best.held", "best.share") == F.struct("held", "share"))
    return (held.withColumn("best", best).groupBy(*key, "span", "label", "held", "share")
            .agg(F.min("place").alias("start"), (F.max("place") + 1).alias("end"), F.max(own).alias("own")).where("own")
            .select("doc_id", "template", "label", "start", "end", "share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base (array), labels (array),
    score: the largest share of a template that a span holds."""
    found = find_spans(docs).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    return base_scan(docs).join(found, "doc_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base",
        F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))).alias("score"))


def digest(result: DataFrame) -> DataFrame:
    def joined(labels: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return result.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"),
                         joined("labels").alias("labels"), "score")
