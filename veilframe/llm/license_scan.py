"""License scan: MinHash bands over overlapping windows of a text retrieve templates, exact containment verifies them."""

from __future__ import annotations

import importlib.resources
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.shingles import mix64, placed_word_hashes
from veilframe.llm.textio import id_and_text, slices_by_bytes, text_buffer, text_offsets

#: Bytes between words: all of ASCII but digits and letters.
_BLANK = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])

#: Notices that name a license in place of its text; fixed values, as the licenses' authors propose them.
NOTICES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def _license_texts() -> dict[str, str]:
    """The whole texts of public licenses that lie beside this module, by name."""
    folder = importlib.resources.files("veilframe.llm") / "licenses"
    return {x.name.removesuffix(".txt"): x.read_text("utf-8") for x in sorted(folder.iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")}


#: All templates: whole license texts, and notices.
LICENSES = _license_texts() | NOTICES


class _Templates:
    """MinHash values of the templates, in classes of like length.

    A class of block length s looks at windows of two blocks of s shingles, one block apart, so that s shingles in a
    row lie in some window. A template of t shingles is in the class with t <= s <= 1.25 t. Where a window holds a
    share c of it the Jaccard similarity is at least c t / (2 s + (1 - c) t), 0.29 at c = 0.8, and with 32 bands of
    one row some band agrees with probability 1 - (1 - 0.29) ** 32 = 0.99998.
    """

    def __init__(self, texts: Mapping[str, str], k: int, bands: int):
        self.k, self.names, self.sets = k, [], []
        for name, text in texts.items():
            data = np.frombuffer(text.encode(), np.uint8)
            words, owner, _, _ = placed_word_hashes(data, np.zeros(1, np.int64), _BLANK)
            grams, ok = self.grams(words, owner)
            if not ok.any():
                raise ValueError(f"template {name} has fewer than {k} words")
            self.names.append(name)
            self.sets.append(np.unique(grams[ok]))
        self.factors = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.classes: dict[int, list[int]] = {}
        for n, own in enumerate(self.sets):
            size = 1
            while size < len(own):
                size = max(size + 1, int(size * 1.25))
            self.classes.setdefault(size, []).append(n)
        self.least = np.array([[self.permuted(own, f).min() for f in self.factors] for own in self.sets], np.uint64).reshape(len(self.sets), bands)
        # permuted() is a bijection, so a window agrees with a template in a band only where it holds the shingle behind its least value
        keys = {size: np.unique(np.concatenate([self.sets[n][[self.permuted(self.sets[n], f).argmin() for f in self.factors]] for n in members])) for size, members in self.classes.items()}
        self.keys = np.unique(np.concatenate(list(keys.values())))
        self.in_class = {size: np.isin(self.keys, own) for size, own in keys.items()}

    @staticmethod
    def permuted(grams: np.ndarray, factor) -> np.ndarray:
        x = grams * factor
        return (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)

    def grams(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each place on, and whether they are all in one text."""
        n = len(words) - self.k + 1
        if n <= 0:
            return words[:0], np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for j in range(self.k):
            out += words[j : j + n] * (mix64(np.array([j + 901], np.uint64)) | np.uint64(1))
        return mix64(out), owner[:n] == owner[self.k - 1 :]

    def candidates(self, grams: np.ndarray, bounds: np.ndarray, containment: float) -> set[tuple[int, int, int]]:
        """(text, first shingle, template) of windows that agree with a template in a band. bounds: where the shingles of each text
        begin, and the end. Texts with too few shingles to contain any template of a class, or without one that is the least of a
        template in some band, are left out of it, since no window of theirs can agree."""
        found: set[tuple[int, int, int]] = set()
        if not len(grams):
            return found
        have = np.diff(bounds)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == grams)
        if not len(hit):
            return found
        key, holder = at[hit], np.searchsorted(bounds, hit, "right") - 1
        grids = {}
        for size, members in self.classes.items():
            holds = np.zeros(len(have), bool)
            holds[holder[self.in_class[size][key]]] = True
            texts = np.flatnonzero(holds & (have >= max(1.0, containment * min(len(self.sets[n]) for n in members))))
            if len(texts):
                count = -(-have[texts] // size)
                owner = np.repeat(texts, count)
                place = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * size
                all_of = len(texts) == len(have) or have[texts].sum() == len(grams)
                rows = None if all_of else np.repeat(bounds[texts] - np.cumsum(have[texts]) + have[texts], have[texts]) + np.arange(have[texts].sum())
                inner = np.repeat(np.cumsum(have[texts]) - have[texts], count) + place
                grids[size] = owner, bounds[owner] + place, inner, rows
        for band, factor in enumerate(self.factors):
            values = self.permuted(grams, factor)
            for size, (texts, starts, inner, rows) in grids.items():
                members = self.classes[size]
                least = np.minimum.reduceat(values if rows is None else values[rows], inner)
                for step in (0, 1) if size > 1 else (0,):
                    window = np.minimum(least[:-1], least[1:]) if step else least
                    same = np.isin(window, self.least[members, band])
                    for k in np.flatnonzero(same):
                        if step and texts[k] != texts[k + 1]:
                            continue
                        for n in members:
                            if window[k] == self.least[n, band]:
                                found.add((int(texts[k]), int(starts[k]), n))
        return found


def license_matches(docs: DataFrame, templates: Mapping[str, str] = LICENSES, k: int = 5, containment: float = 0.8, bands: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, start, end (code points), containment: one row for each place of a whole text that holds
    `containment` or more of a template's k-word shingles.

    Overlapping hits of one template are one row; overlapping hits of different templates, as of two licenses that share
    wording, are a row each. Templates of fewer than k words raise an error. Words are runs of letters and digits in
    lower case. Null, empty and shorter texts have no rows; repeated rows are reported one by one; an empty table
    gives an empty result; other columns are ignored. One narrow pass; the templates are a fixed list (0.2 MB), so
    nothing that grows is held or sent.
    """
    _Templates(templates, k, 1)  # an unfit template is told at once
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "license", "start", "end", "containment"]

    def scan(batches):
        known = _Templates(templates, k, bands)
        for batch in batches:
            texts = batch.column(1)
            offsets, data = text_offsets(texts), text_buffer(texts)
            rows, values = [], []
            for low, high in slices_by_bytes(texts, 4 << 20, 4096):
                part = data[offsets[low] : offsets[high]]
                if not len(part):
                    continue
                starts = offsets[low:high] - offsets[low]
                words, owner, begin, end = placed_word_hashes(part, starts, _BLANK)
                grams, ok = known.grams(words, owner)
                place = np.flatnonzero(ok)
                bounds = np.searchsorted(owner[place], np.arange(high - low + 1))
                grams = grams[place]
                hits: dict[tuple[int, int], list] = {}
                for text, first, n in sorted(known.candidates(grams, bounds, containment)):
                    own, reach = known.sets[n], 2 * len(known.sets[n])
                    a, b = max(bounds[text], first - reach), min(bounds[text + 1], first + 2 * reach + 1)
                    at = a + np.flatnonzero(np.isin(grams[a:b], own))
                    # the stretches of the template's shingles, parted where more than its own length is missing
                    for group in np.split(at, np.flatnonzero(np.diff(at) > len(own)) + 1):
                        share = len(np.unique(grams[group])) / len(own)
                        if len(group) and share >= containment:
                            hits.setdefault((text, n), []).append((int(group[0]), int(group[-1]), share))
                for (text, n), found in sorted(hits.items()):
                    merged: list[list] = []
                    for a, b, share in sorted(set(found)):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1:] = [max(b, merged[-1][1]), max(share, merged[-1][2])]
                        else:
                            merged.append([a, b, share])
                    for a, b, share in merged:
                        from_byte, to_byte = begin[place[a]], end[place[b] + k - 1]
                        chars = lambda x, s=starts[text]: int((part[s:x] & 0xC0 != 0x80).sum())  # noqa: E731  code points before byte x
                        rows.append(low + text)
                        values.append((known.names[n], chars(from_byte), chars(to_byte), share))
            cols = list(zip(*values, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names)

    return source.mapInArrow(scan, f"doc_id {kind}, license string, start long, `end` long, containment double")
