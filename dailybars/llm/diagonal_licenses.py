"""License texts by diagonal voting.

Documents and templates are words (A-Z lower-cased; letters, digits and everything
beyond ASCII).  Every k words in a row of a document are hashed, and Spark joins
all these hashes to the positions of the templates' hashes.  A match votes for the
diagonal (position in the document less position in the template).  Votes are
summed by document, template and diagonal; diagonals at most ``NEAR`` apart are one
place, so a few inserted or missing words do not split it; a place holds if the
words covered by votes are at least ``LEAST`` words (or the whole template) and
``SHARE`` of the stretch between the first and the last.  Licenses share wording, so
every word goes to the places with the most votes over it, and a place that gets less
than half of its words gives no label ("CC BY-NC" inside "CC BY-NC-SA", the GPL's notice inside the
LGPL's).

Documents are named by a hash of their text while votes are counted, so copies
vote once.  The templates are a fixed list of some two thousand words (notices and
full paragraphs, and short statements built from the names of licenses), far below
any broadcast limit; nothing else is broadcast by hand.

Defined results: null texts are empty (0 words, null positions, no labels, score
0); repeated rows are reported one by one; a phrase at several overlapping places
counts each; the score is the best covered share of a template, 1 where a base
phrase stands; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dailybars.llm import batches

K = 3
NEAR = 3
LEAST = 8
SHARE = 0.8

# Base phrases with their labels, and the wording of common notices.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("mit", "Permission is hereby granted, free of charge"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("bsd", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl-notice", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details"),
    ("lgpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details"),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this program"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details"),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
)

# Names of licenses, and their SPDX identifiers; a name of one or two words counts only in a statement.
NAMES = (
    ("mit", ("MIT License", "MIT Licence", "Expat License", "MIT"), ("MIT",)),
    ("isc", ("ISC License", "ISC Licence", "ISC"), ("ISC",)),
    ("bsd", ("BSD License", "BSD Licence", "BSD-style license", "New BSD License", "Simplified BSD License", "BSD"), ("0BSD",)),
    ("bsd-2-clause", ("BSD 2-Clause", "2-Clause BSD"), ("BSD-2-Clause",)),
    ("bsd-3-clause", ("BSD 3-Clause", "3-Clause BSD"), ("BSD-3-Clause",)),
    ("apache", ("Apache License", "Apache Licence"), ()),
    ("apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0"), ("Apache-2.0",)),
    ("gpl", ("GNU GPL", "GPL License", "GPL", "GPL v2", "GPL v3", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"), ("GPL-2.0", "GPL-3.0")),
    ("lgpl", ("GNU Lesser General Public License", "Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL License", "LGPL", "LGPL v2.1", "LGPL v3", "LGPLv2", "LGPLv3", "LGPL-2.1", "LGPL-3.0"), ("LGPL-2.0", "LGPL-2.1", "LGPL-3.0")),
    ("agpl", ("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL License", "AGPL", "AGPL v3", "AGPLv3", "AGPL-3.0"), ("AGPL-3.0",)),
    ("mpl", ("Mozilla Public License", "Mozilla Public Licence"), ()),
    ("mpl-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL v2.0"), ("MPL-2.0",)),
    ("unlicense", ("Unlicense", "Unlicense License"), ("Unlicense",)),
    ("bsl-1.0", ("Boost Software License",), ("BSL-1.0",)),
    ("zlib", ("zlib License", "zlib/libpng License"), ("Zlib",)),
    ("epl", ("Eclipse Public License",), ("EPL-1.0", "EPL-2.0")),
    ("cc0-1.0", ("CC0 1.0", "CC0 License", "CC0 Public Domain Dedication", "CC0"), ("CC0-1.0",)),
)
# Creative Commons licenses by their parts; "by" alone has its own wording.
COMMONS = tuple((parts, " ".join({"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}[p] for p in parts.split("-")))
                for parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"))
STATEMENTS = ("the {}", "under {}", "under a {}", "{} copyright", "license {}", "licence {}")
GRANTS = tuple(f"{verb} under {the}{{}}" for verb in ("licensed", "released", "distributed", "available", "published") for the in ("", "the "))


def _templates():
    out = list(NOTICES)
    for label, names, ids in NAMES:
        out += [(label, f"SPDX-License-Identifier: {i}") for i in ids]
        for name in names:
            words = len(_hashes(name, batches.Powers()))
            out += [(label, s.format(name)) for s in (("{}",) if words > 2 else STATEMENTS if words == 2 else GRANTS)]
    for parts, name in COMMONS:
        label = f"cc-{parts}"
        out += [(label, f"Creative Commons {name}"), (label, f"creativecommons.org/licenses/{parts}"),
                (label, f"Creative Commons {name.replace('Non', 'Non ')}"), (label, f"Creative Commons {name.replace('Share', 'Share ').replace('NoD', 'No D')}"),
                (label, f"This work is licensed under a Creative Commons {name} License")]
        if parts == "by":
            out += [("cc-by-4.0", "Creative Commons Attribution 4.0"), ("cc-by-4.0", "CC BY 4.0"), ("cc-by-4.0", "creativecommons.org/licenses/by/4.0")]
        else:
            out += [(label, f"CC {parts}"), (label, f"This work is licensed under a Creative Commons {name} 4.0 International License")]
    return tuple(dict.fromkeys(out))


GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x61:0x7B] = False
GAP[0x80:] = False


def _hashes(text: str, powers: batches.Powers) -> np.ndarray:
    return batches.words(*batches.utf8(pa.array([text])), powers, GAP)[3]


TEMPLATES = _templates()


def _same(named, doc, phrase):
    """Word numbers (in the slice) where the phrase stands within one document."""
    n = len(named) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = doc[:n] == doc[len(phrase) - 1:]
    for i, h in enumerate(phrase):
        hit &= named[i:n + i] == h
    return np.flatnonzero(hit)


def _scan(k):
    powers = batches.Powers()
    phrases = [(_hashes(p, powers), label) for p, label in PHRASES]

    def scan(tables):
        for batch in tables:
            body, offsets = batches.utf8(batch.column("text"))
            for row, end, part, edges in batches.slices(body, offsets, 2 << 20):
                rows = end - row
                _, _, doc, named = batches.words(part, edges, powers, GAP)
                words = np.bincount(doc, minlength=rows)
                begin = np.cumsum(words) - words
                count, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                labels = [[] for _ in range(rows)]
                for phrase, label in phrases:
                    at = _same(named, doc, phrase)
                    of = doc[at]
                    np.add.at(count, of, 1)
                    np.minimum.at(first, of, at - begin[of])
                    np.maximum.at(last, of, at - begin[of])
                    for d in np.unique(of).tolist():
                        labels[d].append(label)
                gram, of, _ = batches.grams(named, doc, k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))), pa.int32()), pa.array(gram.view(np.int64)))
                part_ = lambda name: batch.column(name).slice(row, rows)
                yield pa.RecordBatch.from_arrays(
                    [part_("doc_id"), part_("key"), pa.array(words), pa.array(count), pa.array(first, mask=count == 0), pa.array(last, mask=count == 0),
                     pa.array([sorted(set(x)) for x in labels], pa.list_(pa.string())), lists],
                    names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base", "grams"])

    return scan


def scan(docs: DataFrame, k: int = K, near: int = NEAR, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Base phrases and voted licenses of every document."""
    spark, powers = docs.sparkSession, batches.Powers()
    places, lengths = [], []
    for t, (label, text) in enumerate(TEMPLATES):
        named = _hashes(text, powers)
        gram, _, at = batches.grams(named, np.zeros(len(named), np.int64), k)
        places += [(int(g), t, int(p)) for g, p in zip(gram.view(np.int64), at)]
        lengths.append((t, label, len(named)))
    templates = F.broadcast(spark.createDataFrame(places, "gram long, template int, at int"))
    named = F.broadcast(spark.createDataFrame(lengths, "template int, label string, length int"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    scanned = keyed.mapInArrow(_scan(k), "doc_id long, key binary, n_words long, n_base long, first_word long, last_word long, base array<string>, grams array<long>")
    votes = (scanned.select("key", F.posexplode("grams").alias("place", "gram")).join(templates, "gram")
             .select("key", "template", "place", (F.col("place") - F.col("at")).alias("diagonal")).distinct())
    by = Window.partitionBy("key", "template")
    lines = votes.groupBy("key", "template", "diagonal").agg(F.array_sort(F.collect_list("place")).alias("places"))  # the votes of one document
    new = (F.col("diagonal") - F.lag("diagonal").over(by.orderBy("diagonal")) > near).cast("int")
    group = F.sum(F.coalesce(new, F.lit(0))).over(by.orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0))
    merged = lines.withColumn("band", group).groupBy("key", "template", "band").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("p"))
    covered = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.when(i < F.size("p"), F.least(F.lit(k), F.element_at("p", i + 1) - F.element_at("p", i))).otherwise(F.lit(k))), F.lit(0), lambda a, b: a + b)
    held = (merged.withColumn("covered", covered).withColumn("stretch", F.element_at("p", -1) - F.element_at("p", 1) + k).join(named, "template")
            .filter((F.col("covered") >= F.least(F.lit(least), F.col("length"))) & (F.col("covered") >= share * F.col("stretch"))))
    reach = F.sequence(F.element_at("p", 1), F.element_at("p", -1) + k - 1)
    most = F.max("votes").over(Window.partitionBy("key", "word"))  # the places over one word: bands of the templates
    kept = (held.withColumn("votes", F.size("p")).withColumn("word", F.explode(reach)).withColumn("most", most)
            .groupBy("key", "template", "band", "label", "length", "covered").agg((F.avg((F.col("votes") == F.col("most")).cast("int")) >= 0.5).alias("holds")))
    found = kept.groupBy("key").agg(F.collect_set(F.when(F.col("holds"), F.col("label"))).alias("more"), F.max(F.least(F.lit(1.0), F.col("covered") / F.col("length"))).alias("share"))
    whole = scanned.drop("grams").join(found, "key", "left")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return whole.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
