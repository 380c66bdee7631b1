"""License scans by an exact set-similarity join, with DataFrame functions alone.

Each text's words are cut into runs of ``RUN`` words; neighbouring runs make blocks that overlap by half. A template of at most ``RUN``
words meets blocks of two runs, a longer one blocks of twice as many runs as it takes, a power of two: any place of so many words lies
within a block, whatever lines it runs over. A block matches a template if it holds at least ``PERCENT`` of the template's distinct words and
all its identifying words. Template words are ordered by their document frequency over all texts, rarest first. Prefix filter: a match
shares one of the template's first |T| - need + 1 words. Length filter: the block holds at least ``need`` template words. Positional
filter: the words left behind the shared one suffice. Survivors are counted exactly; every template that a block meets gives it a label, but
one whose words in the block all belong to another that it meets with more of its words, or more words.

Besides, every place is found where the words of a base phrase stand consecutively. Texts are cut into words once: what the join and the
result need, the runs' template words and the base places, is written to the shared folder.

Defined results: a null text is an empty one, without words, labels or places; repeated rows are scanned each on its own; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lower_ascii, materialize, table

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN, PERCENT = 24, 80
#: Phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Statements and notices of well-known licenses, the labels that the join adds, and the words that identify them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc sa"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general licensed"),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1", "gnu lesser"),
    ("mit", "Released under the MIT License", "mit"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "affero",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "governing warranties conditions",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "redistributions binary disclaimer",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "endorse contributors",
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
        "organization accompanying",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu general",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        "fee permission",
    ),
    (
        "lgpl-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "lesser",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "sublicense restriction",
    ),
    (
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
        "anyone compile",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely",
        "alter freely",
    ),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NO_WORD), "")


def _plain(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.lower()) if w]


def _places(words: Column) -> Column:
    """Structs (at, label) of all base places; only texts that hold a first word are walked."""
    at = lambda i: F.coalesce(*(F.when(F.get(words, i) == p.split()[0], F.when(_follows(words, i, p.split()), F.lit(label))) for p, label in PHRASES.items()))
    every = F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("at"), at(i).alias("label"))), lambda x: x["label"].isNotNull())
    none = F.array().cast("array<struct<at:int,label:string>>")
    first = F.array(*(F.lit(w) for w in sorted({p.split()[0] for p in PHRASES})))
    return F.when(F.arrays_overlap(words, first), every).otherwise(none)


def _follows(words: Column, i: Column, phrase: list[str]) -> Column:
    out = F.lit(True)
    for k, w in enumerate(phrase[1:], 1):
        out = out & F.coalesce(F.get(words, i + k) == w, F.lit(False))
    return out


def _spans(text: str) -> int:
    """Runs that a template takes, as a power of two."""
    runs, out = -(-len(_plain(text)) // RUN), 1
    while out < runs:
        out *= 2
    return out


def cut(docs: DataFrame, keep: dict, text_col: str, templates) -> DataFrame:
    """``keep`` columns plus uid, n_words, places, and runs: for each run of words the distinct template words in it. Written, so that texts are
    cut into words once, and the numbers hold."""
    universe = sorted({w for _, text, _ in templates for w in _plain(text)})
    worded = docs.select(*(c.alias(n) for n, c in keep.items()), F.monotonically_increasing_id().alias("uid"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    masked = F.transform("words", lambda w: F.when(w.isin(universe), w))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(RUN))
    # the array is bound by a lambda, or it would be computed for each run; slices would copy it for each
    runs = F.get(F.transform(F.array(masked), lambda m: F.transform(starts, lambda i: F.array_distinct(F.array_compact(F.array(*(F.get(m, i + k) for k in range(RUN))))))), F.lit(0))
    return materialize(worded.select(*keep, "uid", F.size("words").cast("long").alias("n_words"), _places(F.col("words")).alias("places"), runs.alias("runs")))


def matches(runs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(uid, label, containment): the templates that some block of the text (uid, runs) holds, but those explained by another one."""
    spark = runs.sparkSession
    df = runs.select(F.explode(F.array_distinct(F.flatten("runs"))).alias("w")).groupBy("w").count().collect()  # a row a template word
    count = {r.w: r["count"] for r in df}
    order = {w: k for k, w in enumerate(sorted({w for _, text, _ in templates for w in _plain(text)}, key=lambda w: (count.get(w, 0), w)))}
    rank = F.create_map(*(x for w, k in order.items() for x in (F.lit(w), F.lit(k))))
    out = None
    for spans in sorted({_spans(text) for _, text, _ in templates}):
        rows = []
        for n, (label, text, must) in enumerate(templates):
            if _spans(text) == spans:
                ranked = sorted(set(_plain(text)), key=order.get)
                need = -(-percent * len(ranked) // 100)
                rows += [(n, label, ranked, must.split(), need, k, ranked[k]) for k in range(len(ranked) - need + 1)]
        index = spark.createDataFrame(rows, "n int, label string, words array<string>, must array<string>, need int, at int, w string")  # prefixes of the templates
        prefix = sorted({r[-1] for r in rows})
        some = runs.where(F.arrays_overlap(F.flatten("runs"), F.array(*map(F.lit, prefix))))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("runs") / spans).cast("int") * spans - 2 * spans), F.lit(spans))
        none = F.array().cast("array<string>")
        whole = some.select("uid", F.explode(F.transform(starts, lambda i: F.array_distinct(F.concat(*(F.coalesce(F.get("runs", i + k), none) for k in range(2 * spans)))))).alias("words"))
        ranked = F.array_sort(F.transform("words", lambda w: F.struct(rank[w].alias("rank"), w.alias("w"))))
        blocks = whole.where(F.arrays_overlap("words", F.array(*map(F.lit, prefix)))).select("uid", F.transform(ranked, lambda x: x["w"]).alias("held"))
        probes = blocks.select("uid", "held", F.posexplode("held").alias("held_at", "w"))
        joined = probes.join(F.broadcast(index), "w").where(F.size("held") >= F.col("need"))
        possible = F.least(F.size("held") - F.col("held_at"), F.size("words") - F.col("at")) + F.least("held_at", "at")
        shared = F.array_intersect("words", "held")
        met = joined.where(possible >= F.col("need")).where((F.size(shared) >= F.col("need")) & (F.size(F.array_except("must", "held")) == 0))
        met = met.select("uid", "held", F.struct((F.size(shared) / F.size("words")).alias("c"), F.size(shared).alias("k"), "n", "label", shared.alias("shared")).alias("m"))
        block = met.groupBy("uid", "held").agg(F.collect_set("m").alias("ms"))  # a template each at most
        more = lambda b, m: (b["c"] > m["c"]) | ((b["c"] == m["c"]) & (b["k"] > m["k"]))
        explained = lambda m: F.exists("ms", lambda b: more(b, m) & (F.size(F.array_except(m["shared"], b["shared"])) == 0))
        one = block.select("uid", F.explode(F.filter("ms", lambda m: ~explained(m))).alias("m")).select("uid", "m.label", "m.c")
        out = one if out is None else out.union(one)
    return out.groupBy("uid", "label").agg(F.max("c").alias("containment"))


def scan(docs: DataFrame, keep: dict, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """``keep`` columns plus n_words, n_base, first_word, last_word, base_labels, labels and score, the largest containment found."""
    based = cut(docs, keep, text_col, templates)
    # the labels are few, so a text's matches are a short list
    found = matches(based.select("uid", "runs"), templates).groupBy("uid").agg(F.collect_set("label").alias("own"), F.max("containment").alias("score"))
    at, label = F.col("places.at"), F.col("places.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return based.drop("runs").join(found, "uid", "left").select(
        *keep,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(label).alias("base_labels"),
        joined(F.concat(label, F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), {"doc_id": F.col("doc_id")})


def oracle() -> str:
    """Brute force in SQL: every block against every template."""
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    listed = lambda ws: f"[{', '.join(repr(w) for w in ws)}]"
    sets = ", ".join(f"({n}, '{label}', {_spans(text)}, {listed(sorted(set(_plain(text))))}, {listed(must.split())})" for n, (label, text, must) in enumerate(TEMPLATES))
    phrase = " union all ".join(f"select rid, unnest(list_filter(range(1, len(w) + 1), lambda i: {' and '.join(f'coalesce(w[i + {k}], %s) = %s' % (repr(''), repr(x)) for k, x in enumerate(p.split()))})) - 1 as at_, '{label}' as label from d" for p, label in PHRASES.items())
    return f"""
with d as (select row_number() over () as rid, doc_id, {words("coalesce(text, '')")} as w from documents),
templates(n, label, spans, ws, must) as (values {sets}),
sizes as (select distinct spans from templates),
places as ({phrase}),
starts as (select rid, w, spans, unnest(range(0, greatest(1, cast(ceil(greatest(1, ceil(len(w) / {RUN})) / spans) as bigint) - 1))) * spans * {RUN} as s from d, sizes where len(w) > 0),
blocks as (select rid, spans, s, list_distinct(w[s + 1 : s + 2 * spans * {RUN}]) as b from starts),
met as (select rid, spans, s, n, label, list_intersect(ws, b) as shared, len(list_intersect(ws, b)) / len(ws) as c from blocks join templates using (spans)
  where 100 * len(list_intersect(ws, b)) >= {PERCENT} * len(ws) and list_has_all(b, must)),
own as (select rid, label, max(c) as c from met m where not exists (select 1 from met x where x.rid = m.rid and x.spans = m.spans and x.s = m.s
  and (x.c > m.c or (x.c = m.c and len(x.shared) > len(m.shared))) and list_has_all(x.shared, m.shared)) group by rid, label),
base as (select rid, count(*) as n, min(at_) as lo, max(at_) as hi, string_agg(distinct label, ',' order by label) as labels from places group by rid),
every as (select rid, string_agg(distinct label, ',' order by label) as labels from (select rid, label from places union all select rid, label from own) group by rid),
best as (select rid, max(c) as c from own group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(base.n, 0) as bigint) as n_base, cast(base.lo as bigint) as first_word, cast(base.hi as bigint) as last_word,
  coalesce(base.labels, '') as base_labels, coalesce(every.labels, '') as labels, cast(coalesce(best.c, 0) as double) as score
from d left join base using (rid) left join every using (rid) left join best using (rid)"""
