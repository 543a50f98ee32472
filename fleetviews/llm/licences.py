"""Licence scan: passages compared to licence templates by Dice over word bigrams, in DataFrame functions.

Passages are the lines and the paragraphs (parted by blank lines) of a text, each once. Text is
lower-cased and every run of other characters than a-z and 0-9 becomes one blank. Two sets of
bigrams can reach a coefficient t only if neither is larger than (2 - t) / t times the other; these
bounds decide which passages are looked at and which templates each is compared to. A document's
licence is that of its best passage, ties by name.

Templates are the notices of ``TEMPLATES``, which the SQL statement has too, the short wordings and
headers of ``NOTICES`` and ``NAMES``, and every paragraph of the standard texts in ``licence_texts``.
A paragraph that two licences share word for word names neither; the conditions common to the BSD
licences are ``BSD-any``, which sorts behind those that a further passage names.

Null and empty texts, and those without a matching passage, have no licence. Rows that repeat an id
are documents of their own. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: Usual one-line notices and openings of licences.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Full names, put into the usual short wordings.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License", "MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "Zlib": ["zlib License"],
}
WORDINGS = (
    "{}", "The {}", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.",
    "This project is licensed under the {}.", "This software is licensed under the {}.",
    "This work is licensed under a {}.", "This project is licensed under the {} - see the LICENSE file for details.",
)
_GNU = (
    "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published"
    " by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_EPL = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
    " {version} which accompanies this distribution, and is available at {at}"
)
#: Headers of source files.
NOTICES = {
    "AGPL-3.0": [_GNU.format(it="This program", name="Affero General Public License", version="3")],
    "EPL-1.0": [_EPL.format(version="v1.0", at="http://www.eclipse.org/legal/epl-v10.html")],
    "EPL-2.0": [_EPL.format(version="2.0", at="https://www.eclipse.org/legal/epl-2.0/")],
    "GPL-2.0": [_GNU.format(it="This program", name="General Public License", version="2")],
    "GPL-3.0": [_GNU.format(it="This program", name="General Public License", version="3")],
    "LGPL-2.1": [_GNU.format(it="This library", name="Lesser General Public License", version="2.1")],
    "LGPL-3.0": [_GNU.format(it="This library", name="Lesser General Public License", version="3")],
}
TEXTS = Path(__file__).parent / "licence_texts"
LEAST = 0.8
#: Bigrams of a paragraph of a standard text; shorter ones are headings and list marks of any document.
LEAST_BIGRAMS = 12
OTHER = "[^a-z0-9]+"
BLANK_LINE = "\\n[\\x20\\x09\\x0B-\\x0D]*\\n"


def _template_bigrams(text: str) -> list[str]:
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bounds(n: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams that can reach ``least`` with a set of ``n``."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


@cache
def known() -> list[tuple[str, list[str]]]:
    """Name and bigrams of every template; those of two licences are left out, unless ``TEMPLATES`` has them."""
    fixed = {(name, tuple(_template_bigrams(text))) for name, texts in TEMPLATES.items() for text in texts}
    more = [(name, text) for name, texts in NOTICES.items() for text in texts]
    more += [(name, form.format(full)) for name, fulls in NAMES.items() for full in fulls for form in WORDINGS]
    for path in sorted(TEXTS.glob("*.txt")):
        more += [(path.stem, part) for part in re.split(BLANK_LINE, path.read_text("utf-8"))]
    found = fixed | {(name, tuple(grams)) for name, text in more if (grams := _template_bigrams(text))}
    names: dict[tuple[str, ...], set[str]] = {}
    for name, grams in found:
        names.setdefault(grams, set()).add(name)
    heads = {tuple(_template_bigrams(form.format(x))) for xs in NAMES.values() for x in xs for form in WORDINGS}
    return sorted(
        (name, list(grams)) for name, grams in found
        if (name, grams) in fixed
        or (len(names[grams]) == 1 and (len(grams) >= LEAST_BIGRAMS or grams in heads))
    )


def scanned(docs: DataFrame, key: str, templates=None, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, license, dice and n_passages, the passages that match."""
    if templates is None:
        all_ = known()
    else:
        all_ = [(name, _template_bigrams(text)) for name, texts in templates.items() for text in texts]
    reach = [_bounds(len(grams), least) for _, grams in all_]
    text = F.col("text_")
    passages = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, BLANK_LINE)))
    units = docs.select(F.col(key).alias("key"), common.text_of().alias("text_")).select(
        "key", F.explode(passages).alias("passage")
    )
    plain = F.trim(F.regexp_replace(F.translate(
        "passage", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ), OTHER, " "))
    # A set of bigrams is never larger than the words; short of the least bound nothing can match.
    units = common.once(units, words=F.split(plain, " ")).filter(F.size("words") > min(low for low, _ in reach))
    at = F.sequence(F.lit(1), F.size("words") - 1)
    grams = F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i))))
    most = max(high for _, high in reach)
    # A match shares more than n * least / (2 - least) bigrams with a template; most passages end here.
    every = ", ".join(f"'{g}'" for g in sorted({g for _, grams_ in all_ for g in grams_}))
    units = common.once(units.select("key", "words"), grams=grams).withColumn("n", F.size("grams"))
    units = units.filter(F.col("n") <= most).filter(
        F.expr(f"size(filter(grams, g -> g IN ({every})))") >= F.col("n") * (least / (2 - least)) - 1e-9
    )
    templates_ = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.split(F.lit("|".join(grams_)), "\\|").alias("grams"),
            F.lit(low).alias("low"), F.lit(high).alias("high"),
        )
        for (name, grams_), (low, high) in zip(all_, reach)
    ])

    def compared(t: Column) -> Column:
        dice = 2 * F.size(F.array_intersect("grams", t["grams"])) / (F.col("n") + F.size(t["grams"]))
        return F.struct((-dice).alias("less"), t["license"].alias("license"))

    best = F.array_min(F.transform(F.filter(templates_, lambda t: F.col("n").between(t["low"], t["high"])), compared))
    matched = (
        common.once(units, best=best).filter(F.col("best.less") <= -least)
        .groupBy("key").agg(F.min("best").alias("best"), F.count("*").alias("n_passages"))
    )
    return docs.select(F.col(key).alias("key"), F.col("doc_id").cast("long")).join(matched, "key", "left").select(
        "key", "doc_id", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = common.keyed(common.documents(spark, sf_dir))
    return scanned(docs, key).drop("key")


def _sql_rows() -> str:
    return ", ".join(
        f"('{name}', {_template_bigrams(text)!r})" for name, texts in TEMPLATES.items() for text in texts
    )


OP7_SQL = f"""
WITH templates(license, grams) AS (VALUES {_sql_rows()}),
passages AS (
  SELECT DISTINCT doc_id, passage FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS passage FROM documents
    UNION ALL
    SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[\\x20\\x09\\x0B-\\x0D]*\\n')) FROM documents)),
worded AS (
  SELECT doc_id, passage, string_split(trim(regexp_replace(
    translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM passages),
grammed AS (
  SELECT doc_id, passage, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS grams
  FROM worded WHERE len(w) > 1),
compared AS (
  SELECT doc_id, license, 2 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice,
    g.passage
  FROM grammed g JOIN templates t
    ON len(g.grams) BETWEEN len(t.grams) * {LEAST} / {2 - LEAST} - 1e-9 AND len(t.grams) * {2 - LEAST} / {LEAST} + 1e-9),
found AS (
  SELECT doc_id, passage, min((-dice, license)) AS best FROM compared WHERE dice >= {LEAST} GROUP BY ALL),
matched AS (
  SELECT doc_id, min(best) AS best, count(*) AS n_passages FROM found GROUP BY doc_id)
SELECT d.doc_id, best[2] AS license, -best[1] AS dice, coalesce(n_passages, 0) AS n_passages
FROM documents d LEFT JOIN matched USING (doc_id)
"""
