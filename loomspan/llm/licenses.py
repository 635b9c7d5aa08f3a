"""License scans: MinHash bands over overlapping text windows, verified exactly.

Templates are licenses' own texts and notices. A template of n five-word
shingles has the scale L, the power of two with L/2 < n <= L. A document's
shingles are cut into blocks of L/2, and every three neighbouring blocks are a
window, so any n consecutive shingles lie within one window whole. The window
and a template of which it holds 80 % have a Jaccard similarity of ``LEAST``
(0.25) at least; the number of bands, of one MinHash value each, is what makes
them meet with probability ``RECALL``. Where they meet, the share of the
template's shingles that the window and its surroundings hold is counted
exactly; ``CONTAINED`` of them make a match.

Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case.
Of matches at overlapping places the template at least twice as long stays, else
the one more fully held (a version's notice resembles the next version's).

Defined results: null or empty texts match nothing. A template of fewer than
five words has one shingle, of all its words, and matches a text of exactly
these words. A repeated document is reported as often as it occurs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import tokens as tk

WORDS, CONTAINED, LEAST, RECALL = 5, 0.8, 0.25, 0.9999
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - LEAST))

# Notices and the operative passages of well-known licenses.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-3.0 text": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "Apache-2.0 text": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC0-1.0 deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "MIT-style notice": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "BSD-style notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0 SPDX": "SPDX-License-Identifier: Apache-2.0",
    "MPL-2.0 SPDX": "SPDX-License-Identifier: MPL-2.0",
    "EPL-2.0 SPDX": "SPDX-License-Identifier: EPL-2.0",
    "BSD-2-Clause SPDX": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "GPL-2.0-only SPDX": "SPDX-License-Identifier: GPL-2.0-only",
    "GPL-2.0-or-later SPDX": "SPDX-License-Identifier: GPL-2.0-or-later",
    "GPL-3.0-only SPDX": "SPDX-License-Identifier: GPL-3.0-only",
    "GPL-3.0-or-later SPDX": "SPDX-License-Identifier: GPL-3.0-or-later",
    "LGPL-2.1-or-later SPDX": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "AGPL-3.0-or-later SPDX": "SPDX-License-Identifier: AGPL-3.0-or-later",
}


@dataclass
class Index:
    """Templates by scale; keys[L][band] is sorted, owner[L][band][k] the template of its key k."""

    names: list[str]
    sets: list[np.ndarray]
    keys: dict[int, np.ndarray]
    owner: dict[int, np.ndarray]
    flips: np.ndarray
    odds: np.ndarray


def build(templates: dict[str, str], bands: int = BANDS) -> Index:
    rng = np.random.Generator(np.random.PCG64(11))
    flips = rng.integers(0, 1 << 63, bands, dtype=np.uint64) * tk.U(2)
    odds = rng.integers(0, 1 << 63, bands, dtype=np.uint64) * tk.U(2) + tk.U(1)
    names, texts = list(templates), list(templates.values())
    values, at = tk.shingles(_words(pa.array(texts, pa.large_string())), WORDS)
    unique, begin = tk.row_sets(values, at)
    sets = [unique[a:b] for a, b in zip(begin[:-1], begin[1:])]
    index = Index(names, sets, {}, {}, flips, odds)
    scales: dict[int, list[int]] = {}
    for i, n in enumerate(np.diff(at).tolist()):
        if n:
            scales.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(i)
    for scale, members in scales.items():
        keys = np.array([[((sets[i] ^ f) * o).min() for i in members] for f, o in zip(flips, odds)], np.uint64)
        order = np.argsort(keys, axis=1, kind="stable")
        index.keys[scale], index.owner[scale] = np.take_along_axis(keys, order, 1), np.array(members)[order]
    return index


def _words(column: pa.Array) -> tk.Words:
    return tk.words(column, tk.PUNCTUATION, tk.LOWER)


def find(w: tk.Words, index: Index) -> list[tuple[int, int, float, int, int]]:
    """(row, template, share of its shingles, first word, words of the place) for each match, the best place of each row and template."""
    values, at = tk.shingles(w, WORDS)
    if not len(values):
        return []
    places: set[tuple[int, int, int]] = set()
    marks = {}
    for scale, keys in index.keys.items():
        half = scale // 2
        blocks = -(-np.diff(at) // half)
        first = np.repeat(at[:-1], blocks)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        tables = np.zeros((len(keys), 1 << 16), bool)
        for b, row in enumerate(keys):
            tables[b, row >> tk.U(48)] = True
        marks[scale] = (first + nth * half, half, tables)
    for b in range(len(index.flips)):
        v = (values ^ index.flips[b]) * index.odds[b]
        for scale, (starts, half, tables) in marks.items():
            least = v if half == 1 else np.minimum.reduceat(v, starts)
            # A window at the end of a row reaches into the next one; that adds no more than it would have in a longer row.
            window = least.copy()
            np.minimum(window[:-1], least[1:], out=window[:-1])
            np.minimum(window[:-2], least[2:], out=window[:-2])
            near = np.flatnonzero(tables[b][window >> tk.U(48)])
            row, owner = index.keys[scale][b], index.owner[scale][b]
            low, high = np.searchsorted(row, window[near]), np.searchsorted(row, window[near], "right")
            for j, k, end in zip(near.tolist(), low.tolist(), high.tolist()):
                places.update((int(starts[j]), i, scale) for i in owner[k:end].tolist())
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for start, i, scale in sorted(places):
        r0 = int(np.searchsorted(at, start, "right")) - 1
        # The window may begin in one row and its template stand in the next.
        for r in {r0, min(int(np.searchsorted(at, min(start + 3 * scale // 2, at[-1]) - 1, "right")) - 1, len(at) - 2)}:
            low, high = max(int(at[r]), start - scale), min(int(at[r + 1]), start + 5 * scale // 2)
            if low >= high:
                continue
            held = np.isin(values[low:high], index.sets[i])
            share = len(np.unique(values[low:high][held])) / len(index.sets[i])
            if share >= CONTAINED - 1e-9 and share > best.get((r, i), (0.0, 0, 0))[0]:
                hit = np.flatnonzero(held)
                best[r, i] = (share, low + int(hit[0]) - int(at[r]), int(hit[-1] - hit[0]) + WORDS)
    by_row: dict[int, list[tuple]] = {}
    for (r, i), x in sorted(best.items()):
        by_row.setdefault(r, []).append((r, i, *x))
    return [m for found in by_row.values() for m in found if not any(_beats(o, m, index) for o in found)]


def _beats(a: tuple, b: tuple, index: Index) -> bool:
    """Of two matches at one place, the template at least twice as long wins, else the one more fully held."""
    if a[1] == b[1] or a[3] + a[4] <= b[3] or b[3] + b[4] <= a[3]:
        return False
    x, y = len(index.sets[a[1]]), len(index.sets[b[1]])
    return x >= 2 * y or y < 2 * x and a[2] > b[2]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each document and license found: doc_id, license, share, first_word, n_span."""
    shared = docs.sparkSession.sparkContext.broadcast(build(templates or TEMPLATES))  # as many as the caller holds in memory

    def run(batches):
        index = shared.value
        for batch in batches:
            for part in tk.slices(batch):
                got = find(_words(part.column("text")), index)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())),
                        pa.array([index.names[g[1]] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64()),
                        pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64()),
                    ],
                    ["doc_id", "license", "share", "first_word", "n_span"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, share double, first_word bigint, n_span bigint")
