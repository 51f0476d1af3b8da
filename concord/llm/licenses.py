"""Find licence paragraphs with a trained classifier, in DataFrame functions only.

A multinomial logistic regression over sparse word n-grams is fitted on whole
licence notices, parts of them, and sentences that name a licence, against
prose and against shuffled notices; a temperature fitted on other wordings
calibrates it, the unknown class included.  Paragraphs are scored by joining
their n-grams with the weights; what is predicted is confirmed by comparison
with the clauses of the family's notices.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices as their licences word them, a paragraph each.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "boost": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "public-domain": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work is in the public domain.",
    ],
    "proprietary": [
        "All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information.", "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Names that texts call the licences by.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"], "mit": ["MIT License", "Expat License"], "isc": ["ISC License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-style license", "BSD License"], "gpl": ["GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL version 2 or later", "GPL version 3", "GPLv2", "GPLv3"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 3", "LGPLv3"], "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3"],
    "mpl": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"], "epl": ["Eclipse Public License 2.0", "EPL 2.0"], "boost": ["Boost Software License, Version 1.0"], "zlib": ["zlib License"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 3.0"], "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"], "cc0": ["CC0 1.0 Universal"], "public-domain": ["Unlicense"],
}
#: Sentences that name a licence: those learned from, and those that calibration and the held-out test use.
FORMS = ["{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "Distributed under the terms of the {}.", "The code is available under the {}."]
OTHER_FORMS = ["This project is distributed under the {}.", "Published under the {}, see the file.", "You may use the library under the {}.", "Its source is covered by the {}."]
#: Prose with the words of notices that is none: every third sentence is held out.
PROSE = [
    "The driver lost his license after the accident.", "Permission to enter the building is granted by the guard.", "Version 2.0 of the program is free for all.", "He said all rights reserved is old.",
    "She has a license to practice medicine in the state.", "The public library is open to the general public.", "The Apache people lived in the plains.", "He studied at MIT for four years.", "The phrase all rights reserved was printed on the ticket by mistake.",
    "The foundation gives free software to schools.", "The rights of all people must be reserved for law.", "A copy of the book was sent to any person.", "All seats are reserved.", "Civil rights and the law.",
    "The terms of the contract are subject to change.", "Use the source of the river and the binary star.", "The domain name is public.", "The author of this work released a new book.", "Attribution of the painting is disputed.",
    "This work is hard.", "Conditions are met.", "Redistribution of land was permitted.", "Under the bridge.", "The license plate, version 3.", "General knowledge, version 4.0.", "This program is on at nine.",
    "The court found the company liable for damages arising from the accident.", "Without any warranty the buyer paid less for the car.", "Copies of the report were distributed to the press.", "The software failed in the hope of a better one.", "The eclipse was public in 2017.",
    "A boost to the economy, version 1.0 of the plan.", "Mozilla released a browser to the public.", "The GNU project began in 1983.", "Creative people share their work in common rooms.", "The gnu lives in general in the savanna.", "Her driving license was under the seat.",
    "The commercial was not for any purpose.", "The domain of the function is public knowledge.", "Notice of the meeting shall appear in all papers.", "The publisher gave written permission for the visit.", "Confidential talks were held by the company.",
]
UNKNOWN = "unknown"
#: Words that say nothing by themselves: an n-gram needs another one, and a line without any other is not looked at.
COMMON = frozenset(
    "a about above after all along also an and any anyone appear are as at be been but by can change code copy data do each either even event except file files following for form forms found free from furnished general has have he her his how if in including into is it "
    "its kind language law list lost loss made may means met more must name names new no nor not of on one open option or other others out part people person persons program project public s see sell sent set shall should so software some source state such "
    "term terms than that the their them then there these they this to under up use used useful version via view was way we were what when where whether which who will with without work would written you your".split()
)
WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
PATTERN = r"[a-z0-9]+(?:\.[0-9]+)*"
SENTENCE = r"[.!?;:]+(?:\s+|\z)"
BLANKS = " \t\n\x0b\f\r"
#: Clauses under this many words must make up most of a sentence; longer ones must be there by most of their trigrams.
SHORT = 6


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams(text: str, most: int = 3) -> set[str]:
    words = words_of(text)
    found = {" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)}
    return {g for g in found if not set(g.split()) <= COMMON}


def clauses() -> list[tuple[str, str, int]]:
    """``(family, words, slack)``: sentences of the notices, and the licences' names; ``slack`` is how many other words a sentence may have."""
    found = []
    for family, texts in NOTICES.items():
        for sentence in chain.from_iterable(re.split(SENTENCE.replace(r"\z", r"\Z"), t) for t in texts):
            own = words_of(sentence)
            if len(own) >= 3 and not set(own) <= COMMON:
                found.append((family, " ".join(own), len(own)))
    for family, names in NAMES.items():
        found += [(family, " ".join(words_of(n)), 8) for n in names]
    return list(dict.fromkeys(found))


def samples(seed: int = 3) -> tuple[list, list, list]:
    """``(text, family)`` to learn from, to calibrate by, and to test with; no wording is in two of them.

    Notices are learned whole, by their sentences, and by cuts at one half;
    other cuts, other sentences about the names, and notices between prose are
    for calibration and test.
    """
    rng = np.random.default_rng(seed)
    train, rest = [("", UNKNOWN)], []
    for family, texts in NOTICES.items():
        for text in texts:
            own = text.split()
            train += [(text, family), (text.upper(), family)]
            train += [(s, family) for s in re.split(r"(?<=[.;:]) ", text) if len(words_of(s)) >= SHORT]
            if len(own) >= 16:
                train += [(" ".join(own[: len(own) // 2]), family), (" ".join(own[len(own) // 2 :]), family)]
                rest += [(" ".join(own[: len(own) * 2 // 3]), family), (" ".join(own[len(own) // 4 :]), family)]
            rest.append((f"{PROSE[len(text) % len(PROSE)]} {text} {PROSE[len(own) % len(PROSE)]}", family))
            train += [(" ".join(rng.permutation(own)), UNKNOWN) for _ in range(3)]
            rest.append((" ".join(rng.permutation(own)), UNKNOWN))
    for family, names in NAMES.items():
        train += [(form.format(name), family) for form in FORMS for name in names]
        rest += [(form.format(name), family) for form in OTHER_FORMS for name in names]
    train += [(t, UNKNOWN) for k, t in enumerate(PROSE) if k % 3]
    train += [(" ".join(PROSE[(k + j) % len(PROSE)] for j in (0, 1, 4) if (k + j) % len(PROSE) % 3), UNKNOWN) for k in range(len(PROSE))]
    rest += [(t, UNKNOWN) for k, t in enumerate(PROSE) if not k % 3]
    learned = {text for text, _ in train}
    rest = [x for x in dict.fromkeys(rest) if x[0] not in learned]
    return train, rest[::2], rest[1::2]


class Classifier:
    """Weights ``[n-gram, family]``, a bias, and the temperature that calibrates them."""

    def __init__(self, rounds: int = 600, rate: float = 0.2, decay: float = 2e-3):
        train, calibration, _ = samples()
        self.families = [*NOTICES, UNKNOWN]
        self.vocabulary = sorted({g for text, _ in train for g in grams(text)})
        self.at = {g: k for k, g in enumerate(self.vocabulary)}
        self.weights, self.bias, self.temperature = np.zeros((len(self.vocabulary), len(self.families))), np.zeros(len(self.families)), 1.0
        x, y = self.design(train)
        # the weights are sums of the samples' rows, so the fit needs only how rows overlap
        overlap, one, share = x @ x.T, np.eye(len(self.families))[y], np.zeros((len(x), len(self.families)))
        for _ in range(rounds):
            off = softmax(overlap @ share + self.bias) - one
            share -= rate * (off / np.sqrt(np.diag(overlap) + 1)[:, None] + decay * share)
            self.bias -= rate * off.mean(0)
        self.weights = x.T @ share
        held, truth = self.design(calibration)
        logits = held @ self.weights + self.bias
        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        notices = chain(*NOTICES.values(), *NAMES.values(), FORMS)
        self.cues = sorted({w for text in notices for w in words_of(text) if w not in COMMON and not w.replace(".", "").isdigit()})

    def design(self, rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.vocabulary)))
        for k, (text, _) in enumerate(rows):
            x[k, [self.at[g] for g in grams(text) if g in self.at]] = 1
        return x, np.array([self.families.index(name) for _, name in rows])

    def probabilities(self, text: str) -> np.ndarray:
        own = [self.at[g] for g in grams(text) if g in self.at]
        return softmax((self.weights[own].sum(0) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _gram(n: int):
    return lambda j: F.array_join(F.slice("w", j, n), " ")


def _extract(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(PATTERN), F.lit(0))


def licence_paragraphs(docs: DataFrame, model: Classifier | None = None, least: float = 0.5, overlap: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_hash, paragraph, family, probability, overlap)``: a row for each family found in a paragraph.

    A paragraph is a run of lines with words of notices, in which single lines
    without may lie, but not blank ones; each of its lines is scored, and the lines together, so a notice is found whether it stands in
    one line or is wrapped over many.  One whose best family has a probability
    under ``least`` is unknown.  ``overlap`` is the share of a clause of that
    family that is there: of its trigrams, at least ``overlap`` of them, or, for
    clauses under ``SHORT`` words and names, all its words in one sentence with
    few others.  What no clause confirms gives no row.  Rows equal in id and
    text are one; null ids are an id of their own.  Null and empty texts have
    no paragraph, texts of any length are scanned whole; other columns are
    neither read nor returned; an empty table gives an empty one.
    """
    model = model or Classifier()
    spark = docs.sparkSession
    k = len(model.families)
    text = F.col(f"`{text_col}`")
    # a line without a cue has nothing of a notice but common words and numbers
    cue = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, model.cues)) + ")(?![a-z0-9])"
    split = F.split(F.replace(text, F.lit("\0"), F.lit(" ")), "\n")
    # a generator computes the lines once; a projection would, within the lambda, for each of them
    own = docs.where(text.rlike(cue)).select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("t"), F.explode_outer(F.array(F.transform(split, lambda x: F.struct(x.alias("x"), x.rlike(cue).alias("hit"))))).alias("lines"))
    hit = lambda j: F.coalesce(F.get("lines", j)["hit"], F.lit(False))
    bridge = lambda x, j: (F.trim(x["x"], F.lit(BLANKS)) != "") & hit(j - 1) & hit(j + 1)
    marked = F.transform("lines", lambda x, j: F.when(x["hit"] | bridge(x, j), x["x"]).otherwise(F.lit("\0")))
    own = own.select("i", "t", F.split(F.array_join(marked, "\n"), "\n?\0[\n\0]*").alias("runs"))
    runs = own.select("i", "t", F.posexplode_outer("runs").alias("p", "run")).where("run <> ''").groupBy("i", "t", "p").agg(F.first("run").alias("run"))
    lines = F.split("run", "\n")
    units = runs.select("i", "t", "p", F.posexplode_outer(F.when(F.size(lines) > 1, F.concat(F.array("run"), lines)).otherwise(lines)).alias("u", "unit"))
    words = units.select("i", "t", "p", "u", "unit", _extract(F.col("unit")).alias("w"))
    indexes = F.sequence(F.lit(1), F.size("w"))
    # n-grams that run over the end are shorter; distinct ones count once
    each = F.array_distinct(F.flatten(F.array(*(F.transform(indexes, _gram(n)) for n in (1, 2, 3)))))
    spread = words.select("i", "t", "p", "u", F.explode_outer(F.when(F.size("w") > 0, each)).alias("g"))
    weights = spark.createDataFrame([(g, [float(x) for x in row]) for g, row in zip(model.vocabulary, model.weights, strict=True)], "g string, v array<double>")
    # the vocabulary is that of the fixed notices: some thousands of n-grams
    scored = spread.join(F.broadcast(weights), "g").groupBy("i", "t", "p", "u").agg(*(F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(k)))
    logits = [(F.col(f"s{j}") + float(model.bias[j])) / float(model.temperature) for j in range(k)]
    best = F.greatest(*logits)
    total = sum((F.exp(z - best) for z in logits[1:]), F.exp(logits[0] - best))
    family = F.coalesce(*(F.when(z == best, F.lit(name)) for z, name in zip(logits, model.families, strict=True)))
    judged = scored.select("i", "t", "p", "u", family.alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    held = units.withColumnsRenamed({"i": "wi", "t": "wt", "p": "wp", "u": "wu"})
    compared = judged.join(held, F.col("i").eqNullSafe(F.col("wi")) & (F.col("t") == F.col("wt")) & (F.col("p") == F.col("wp")) & (F.col("u") == F.col("wu")))
    templates = spark.createDataFrame(clauses(), "family string, clause string, slack int")
    shared = confirmation(F.col("unit"), F.col("clause"), F.col("slack"))
    confirmed = compared.join(F.broadcast(templates), "family").groupBy("i", "t", "p", "u", "family", "probability").agg(F.max(shared).alias("overlap")).where(F.col("overlap") >= overlap)
    found = confirmed.groupBy("i", "t", "p", "family").agg(F.max("probability").alias("probability"), F.max("overlap").alias("overlap"))
    return found.select(F.col("i").alias(id_col), F.col("t").alias("text_hash"), F.col("p").alias("paragraph"), "family", "probability", "overlap")


def confirmation(unit: Column, clause: Column, slack: Column) -> Column:
    """The share of a clause that a text holds; see :func:`licence_paragraphs`."""
    own = F.split(clause, " ")
    text = _extract(unit)
    triples = lambda w: F.when(F.size(w) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda j: F.array_join(F.slice(w, j, 3), " ")))).otherwise(F.array().cast("array<string>"))
    share = F.size(F.array_intersect(triples(own), triples(text))) / F.greatest(F.size(triples(own)), F.lit(1))
    sentences = F.transform(F.split(unit, SENTENCE), lambda s: F.concat(F.lit(" "), F.array_join(_extract(s), " "), F.lit(" ")))
    padded = F.concat(F.lit(" "), clause, F.lit(" "))
    within = F.exists(F.concat(sentences, F.array(F.concat(F.lit(" "), F.array_join(text, " "), F.lit(" ")))), lambda s: F.contains(s, padded) & (F.size(F.split(F.trim(s), " ")) <= F.size(own) + slack))
    return F.when(F.size(own) >= SHORT, F.greatest(share, F.when((slack == 8) & within, 1.0).otherwise(0.0))).otherwise(F.when(within, 1.0).otherwise(0.0))


def scan(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_paragraphs, n_licences, families)`` for every row, repeated ones too.

    ``n_paragraphs`` counts the parts of the text that blank lines divide,
    ``n_licences`` the licences of all paragraphs (see
    :func:`licence_paragraphs`).  ``families`` joins the names found, sorted,
    each once, by commas; it is empty where there is none.  A null, empty or
    blank text has no paragraph.  Rows with null or equal ids each have their
    own row; other columns are neither read nor returned, and an empty table
    gives an empty one.
    """
    found = licence_paragraphs(docs, model, id_col=id_col, text_col=text_col)
    text = F.col(f"`{text_col}`")
    grouped = found.groupBy(F.col(id_col).alias("gi"), F.col("text_hash").alias("gt")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f"))
    parts = F.filter(F.split(text, "\n[ \t\r\f\x0b]*\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_paragraphs"))
    joined = rows.join(grouped, F.col("id").eqNullSafe(F.col("gi")) & (F.col("h") == F.col("gt")), "left")
    return joined.select(F.col("id").alias(id_col), F.greatest("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n", F.lit(0)).alias("n_licences"), F.coalesce("f", F.lit("")).alias("families"))
