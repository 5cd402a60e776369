"""License scans by diagonal voting, in built-in functions alone.

Templates of license notices are cut into hashes of ``k`` consecutive words with their positions.
A document's rolling k-gram hashes that the templates hold are joined to those positions; each
match votes for the diagonal (document position minus template position). Neighbouring diagonals
of one template, which insertions and deletions cause, are merged, and a merged group counts if the
words it covers reach ``coverage`` of the template inside one span, each verified word by word
through the join on the gram itself. Fixed phrases are counted besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import once, running, words

K = 4
COVERAGE = 0.6
#: Diagonals at most this many words apart are one group.
SLACK = 3

# Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Sentences of public license notices that often stand alone.
TEMPLATES = (
    ("text-mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("text-mit-warranty", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("text-apache", "Licensed under the Apache License, Version 2.0"),
    ("text-apache-use", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("text-gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("text-gpl-warranty", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("text-bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("text-isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("text-mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("text-cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("text-rights", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form"),
)


# Whole license texts and notices, as their owners publish them for copying.
_WARRANTY = """IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
WHOLE_TEXTS = (
    ("whole-mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("whole-isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("whole-bsd-2", f"{_BSD} {_AS_IS} {_WARRANTY}"),
    ("whole-bsd-3", f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. {_AS_IS} {_WARRANTY}"""),
    ("whole-zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("whole-unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws,
the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law."""),
    ("notice-apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("notice-gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of
the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("notice-mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at https://mozilla.org/MPL/2.0/."""),
)


def template_grams(spark: SparkSession, templates=TEMPLATES + WHOLE_TEXTS, k: int = K) -> DataFrame:
    """(h, gram, label, n_template, tp): every k-gram of every template; shorter ones are one gram."""
    t = spark.createDataFrame(list(templates), "label string, text string").select("label", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - k))
    grams = F.transform(starts, lambda i: F.struct(i.alias("tp"), F.slice(F.col("w"), i + 1, k).alias("g")))
    t = t.select("label", F.size("w").alias("n_template"), F.explode(grams).alias("x"))
    return t.select(F.xxhash64("x.g").alias("h"), F.array_join("x.g", " ").alias("gram"), F.size("x.g").alias("n_gram"), "label", "n_template", "x.tp")


PLACES = "array<struct<p:int,label:string>>"


def _phrase_places(joined: Column, phrases) -> Column:
    """array<struct<p, label>>: word positions of the phrases in text of single-spaced words."""
    parts = []
    for phrase, label in phrases:
        pattern = rf"(?<![^ ]){phrase}(?![^ ])"
        gaps = F.split(joined, pattern)
        spaces = F.transform(gaps, lambda g: F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit(""))))
        places = once(spaces, _places(phrase.count(" "), label)).cast(PLACES)
        parts.append(F.when(F.rlike(joined, F.lit(pattern)), places).otherwise(F.array().cast(PLACES)))
    return F.flatten(F.array(*parts))


def _places(n: int, label: str):
    def places(gaps: Column) -> Column:
        every = F.zip_with(gaps, running(F.transform(gaps, lambda g: g + n)), lambda g, at: F.struct((at + g).alias("p"), F.lit(label).alias("label")))
        # the gap after the last place names none
        return F.slice(every, 1, F.size(gaps) - 1)

    return places


def license_scan(docs: DataFrame, templates=TEMPLATES + WHOLE_TEXTS, phrases=PHRASES, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans (array<struct<label, s, e, share>> of verified template matches in words).

    score: 1 where a base phrase stands, else the largest share of a template that one span holds
    (0 without a span). Null or wordless text: no places, labels empty, positions null, score 0.
    Repeated rows repeat. Labels and phrases are fixed tables that the plan holds whole. Empty
    table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    w = F.col("w")
    joined = F.array_join(w, " ")
    base = base.withColumn("places", F.when(F.rlike(joined, F.lit("|".join(p for p, _ in phrases))), _phrase_places(joined, phrases)).otherwise(F.array().cast(PLACES)))
    held: dict[int, list[str]] = {}
    for r in grams.select("h", "n_gram").distinct().collect():  # as many as the templates have words
        held.setdefault(r["n_gram"], []).append(f"{r['h']}L" if r["h"] > -(2**63) else "-9223372036854775807L - 1")
    hits = []
    for g, values in sorted(held.items()):
        every = F.transform(F.sequence(F.lit(0), F.size(w) - g), _gram_at(w, g))
        base = base.withColumn(f"g{g}", F.when(F.size(w) >= g, every).otherwise(F.array()))
        kept = F.expr(f"filter(g{g}, a -> a.h in ({','.join(values)}))")
        hits.append(F.transform(kept, _with_text(w, g)))
    rows = base.select("row", "doc_id", F.size(w).alias("n_words"), "places", F.explode_outer(F.flatten(F.array(*hits)) if hits else F.array().cast("array<struct<p:int,gram:string>>")).alias("c"))
    rows = rows.select("row", "doc_id", "n_words", "places", F.col("c.p").alias("p"), F.col("c.gram").alias("gram"))
    voted = rows.join(F.broadcast(grams.select("gram", "label", "n_template", "n_gram", "tp")), "gram", "left")
    diagonals = voted.groupBy("row", "doc_id", "n_words", "places", "label", "n_template", (F.col("p") - F.col("tp")).alias("d")).agg(
        F.collect_set(F.struct("p", "tp", "n_gram")).alias("votes")
    )
    by_label = Window.partitionBy("row", "label").orderBy("d")
    near = F.when(F.col("d") - F.lag("d").over(by_label) <= SLACK, 0).otherwise(1)
    grouped = diagonals.withColumn("new", near).withColumn("g", F.sum("new").over(by_label))
    merged = grouped.groupBy("row", "doc_id", "n_words", "places", "label", "n_template", "g").agg(F.flatten(F.collect_list("votes")).alias("votes"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda v: F.sequence(v["tp"], v["tp"] + v["n_gram"] - 1)))))
    merged = merged.select(
        "row", "doc_id", "n_words", "places", "label",
        F.when(F.col("label").isNotNull(), covered / F.col("n_template")).alias("share"),
        F.array_min(F.transform("votes", lambda v: v["p"])).alias("s"),
        F.array_max(F.transform("votes", lambda v: v["p"] + v["n_gram"])).alias("e"),
    )
    span = F.struct("s", "e", "label", "share")
    per_doc = merged.groupBy("row", "doc_id", "n_words", "places").agg(
        F.array_sort(F.collect_set(F.when(F.col("share") >= coverage, span))).alias("spans"), F.coalesce(F.max("share"), F.lit(0.0)).alias("best")
    )
    at = F.transform("places", lambda x: x["p"])
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    n_base = F.size("places")
    return per_doc.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("spans", lambda x: x["label"]))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.col("best")).alias("score"),
        "spans",
    )


def _gram_at(w: Column, g: int):
    return lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(w, i + 1, g)).alias("h"))


def _with_text(w: Column, g: int):
    return lambda a: F.struct(a["p"].alias("p"), F.array_join(F.slice(w, a["p"] + 1, g), " ").alias("gram"))


def op10_licenses(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _sql() -> str:
    """All pairs of equal grams of documents and templates, voted diagonal by diagonal, and phrases by their words."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    split = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join(f"({quoted(label)}, {quoted(text)})" for label, text in TEMPLATES + WHOLE_TEXTS)
    named = ", ".join(f"({quoted(phrase)}, {quoted(label)})" for phrase, label in PHRASES)
    return f"""with d as (select row_number() over () as r, doc_id, {split("coalesce(text, '')")} as w from documents), p as (select r, i, w[i + 1] as word, w[i + 1:i + {K}] as g from d, unnest(range(0, len(w))) as u(i)),
  t as (select label, {split('text')} as w from (values {rows}) v(label, text)), tg as (select label, len(w) as n, i as tp, w[i + 1:i + {K}] as g from t, unnest(range(0, len(w) - {K - 1})) as u(i)),
  v as (select r, label, n, i as p, tp, i - tp as diag from p join tg using (g)), dg as (select distinct r, label, diag from v),
  nw as (select *, case when diag - lag(diag) over (partition by r, label order by diag) <= {SLACK} then 0 else 1 end as new from dg), gr as (select *, sum(new) over (partition by r, label order by diag) as k from nw),
  sh as (select r, label, k, count(distinct tp + j) / max(n)::double as share from v join gr using (r, label, diag), unnest(range(0, {K})) as u(j) group by 1, 2, 3), sc as (select r, max(share) as best from sh group by 1),
  ph as (select string_split(phrase, ' ') as q, label from (values {named}) x(phrase, label)), b as (select r, i, label from p join ph on word = q[1] join d using (r) where w[i + 1:i + len(q)] = q),
  bs as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by 1),
  lb as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from b union all select r, label from sh where share >= {COVERAGE}) q group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double as score from d left join bs using (r) left join sc using (r) left join lb using (r)"""


OP10_SQL = _sql()
