"""Licence scan by sentence rules.

A text is cut into sentences, each normalised (lower case, letters and digits only, single spaces). A line's end may
end a sentence or wrap it: a sentence is any run of whole lines between two marks or blank lines. Sentences that are
known from licence texts and notices map to their identifiers; a document's identifiers, in text order, are then
matched against ordered rules: a rule holds if its identifiers occur in that order, others may stand between them.
All of it is DataFrame functions on the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence texts and notices, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "this software is released under the mit license": "mit-notice",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "released under the apache license version 2 0": "apache-2.0-notice",
    "licensed under the apache license version 2 0 the license": "apache-2.0-notice",
    "apache license version 2 0 january 2004": "apache-2.0-title",
    "apache license": "apache-title",
    "you may not use this file except in compliance with the license": "apache-2.0-compliance",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-see",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "released under the gnu general public license version 3": "gpl-3.0-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "gnu general public license": "gpl-title",
    "version 3 29 june 2007": "gpl-3.0-version",
    "version 2 june 1991": "gpl-2.0-version",
    "version 3 19 november 2007": "agpl-3.0-version",
    "version 2 1 february 1999": "lgpl-2.1-version",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-redistribute",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-redistribute",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-redistribute",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-or-later-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0-or-later-grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3.0-or-later-grant",
    "either version 2 of the license or at your option any later version": "version-2-or-later",
    "either version 2 1 of the license or at your option any later version": "version-2.1-or-later",
    "either version 3 of the license or at your option any later version": "version-3-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "see the gnu general public license for more details": "gpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "licensed under the bsd 2 clause license": "bsd-2-notice",
    "licensed under the bsd 3 clause license": "bsd-3-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "licensed under the isc license": "isc-notice",
    "isc license": "isc-title",
    "mozilla public license version 2 0": "mpl-2.0-title",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-obtain",
    "licensed under the mozilla public license version 2 0": "mpl-2.0-notice",
    "eclipse public license v 2 0": "epl-2.0-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2.0-notice",
    "cc0 1 0 universal": "cc0-1.0-title",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "boost software license version 1 0 august 17th 2003": "bsl-1.0-title",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by 4 0": "cc-by-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "all rights reserved": "all-rights-reserved",
}

#: Ordered rules, (licence, kind, identifiers).
RULES = [
    ("MIT", "text", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", "text", ["mit-title", "mit-grant"]),
    ("MIT", "notice", ["mit-notice"]),
    ("Apache-2.0", "text", ["apache-2.0-notice", "apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-warranty"]),
    ("Apache-2.0", "text", ["apache-2.0-title"]),
    ("Apache-2.0", "notice", ["apache-2.0-notice"]),
    ("GPL-3.0", "text", ["gpl-title", "gpl-3.0-version"]),
    ("GPL-3.0", "notice", ["gpl-3.0-notice"]),
    ("GPL-3.0-or-later", "text", ["gpl-3.0-or-later-grant", "gpl-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", "text", ["gpl-redistribute", "version-3-or-later", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0", "text", ["gpl-title", "gpl-2.0-version"]),
    ("GPL-2.0", "notice", ["gpl-2.0-notice"]),
    ("GPL-2.0-or-later", "text", ["gpl-redistribute", "version-2-or-later", "gpl-warranty", "gpl-see"]),
    ("LGPL-2.1", "text", ["lgpl-title", "lgpl-2.1-version"]),
    ("LGPL-2.1-or-later", "text", ["lgpl-redistribute", "version-2.1-or-later", "gpl-warranty", "lgpl-see"]),
    ("LGPL-3.0", "text", ["lgpl-title", "gpl-3.0-version"]),
    ("LGPL-3.0-or-later", "text", ["lgpl-3.0-or-later-grant", "gpl-warranty", "lgpl-see"]),
    ("AGPL-3.0", "text", ["agpl-title", "agpl-3.0-version"]),
    ("AGPL-3.0-or-later", "text", ["agpl-3.0-or-later-grant", "gpl-warranty", "agpl-see"]),
    ("ISC", "text", ["isc-grant", "isc-warranty"]),
    ("ISC", "notice", ["isc-notice"]),
    ("MPL-2.0", "text", ["mpl-subject", "mpl-2.0-obtain"]),
    ("MPL-2.0", "text", ["mpl-2.0-title"]),
    ("MPL-2.0", "notice", ["mpl-2.0-notice"]),
    ("EPL-2.0", "text", ["epl-2.0-title"]),
    ("EPL-2.0", "notice", ["epl-2.0-notice"]),
    ("CC0-1.0", "text", ["cc0-1.0-title"]),
    ("CC0-1.0", "notice", ["cc0-waiver"]),
    ("Zlib", "text", ["zlib-liability", "zlib-grant"]),
    ("BSL-1.0", "text", ["bsl-1.0-title"]),
    ("BSD-3-Clause", "notice", ["bsd-3-notice"]),
    ("BSD-2-Clause", "notice", ["bsd-2-notice"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", "notice", ["cc-by-nc-4.0-notice"]),
    ("CC-BY-4.0", "notice", ["cc-by-4.0-notice"]),
    ("CC-BY-SA-4.0", "notice", ["cc-by-sa-4.0-notice"]),
    ("Unlicense", "text", ["unlicense-grant"]),
]

#: A sentence ends for certain at . ! ? ; : followed by white space, or at a line without letters and digits.
_MARKS = r"[.!?;:](?=[ \t\r\n])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text in order of their starts, then ends; a null text has none."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # words parted by one blank, by a line's end or, where a sentence ends for certain, by a bar
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _MARKS, "\n\n")), r"[^\p{L}\p{N}\n]+", " ")
    plain = F.regexp_replace(F.concat(F.lit("|"), plain, F.lit("|")), r" ?\n ?", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\n\n+", "|"), r"\| | \|", "|")
    # at each start the longest run that is known; shorter ones from there end at one of its lines' ends
    longest = "|".join(s.replace(" ", r"[ \n]") for s in sorted(SENTENCES, key=len, reverse=True))
    runs = F.regexp_extract_all(plain, F.lit(rf"(?<=[|\n])(?=({longest})[|\n])"), F.lit(1))
    lines = F.transform(runs, lambda r: F.split(r, "\n"))
    ends = F.transform(lines, lambda x: F.transform(x, lambda _, i: F.array_join(F.slice(x, 1, i + 1), " ")))
    hits = F.filter(F.flatten(ends), lambda s: s.isin(list(SENTENCES)))
    return F.transform(hits, lambda s: F.element_at(known, s))


def in_order(ids: Column, rule: list[str]) -> Column:
    """Whether the identifiers of a rule occur in ids in that order; each is sought after the first place of the one before."""
    after = lambda left, x: F.slice(left, (F.array_position(left, x) + 1).cast("int"), F.size(left))
    left = F.aggregate(F.array(*map(F.lit, rule)), ids, lambda left, x: F.when(F.array_position(left, x) > 0, after(left, x)))
    return left.isNotNull()


def scan(docs: DataFrame) -> DataFrame:
    """docs with sentence_ids (array), n_sentences, licences (sorted distinct, comma-joined; empty: none) and n_licences.

    A text that matches the longer of two rules with the same grant (BSD-3-Clause) isn't reported for the shorter.
    Columns of docs with these names are replaced; null and empty texts have no licence; repeats are scanned alike.
    """
    docs = docs.drop("sentence_ids", "n_sentences", "licences", "n_licences")
    found = docs.select("*", F.explode(F.array(sentence_ids(F.col("text")))).alias("sentence_ids"))
    matched = F.array_compact(F.array(*[F.when(in_order(F.col("sentence_ids"), rule), name) for name, _, rule in RULES]))
    matched = F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(matched)))
    found = found.withColumn("_all", matched)
    three = F.array_contains("_all", "BSD-3-Clause")
    licences = F.when(three, F.array_remove("_all", "BSD-2-Clause")).otherwise(F.col("_all"))
    return found.withColumns(
        {
            "n_sentences": F.size("sentence_ids").cast("long"),
            "licences": F.array_join(licences, ","),
            "n_licences": F.size(licences).cast("long"),
        }
    ).drop("_all")


def oracle() -> str:
    """The same in DuckDB SQL, sentence by sentence, over documents; a line's end always ends a sentence here."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = ", ".join(f"({n}, '{name}', {k}, '{x}')" for n, (name, _, ids) in enumerate(RULES) for k, x in enumerate(ids))
    return f"""
    WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
    rules(rule, licence, k, id) AS (VALUES {rules}),
    cut AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM (
        SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[.!?;:]([ \\t\\r])', E'\\n\\\\1', 'g'), E'\\n') AS parts FROM documents)),
    hits AS (SELECT doc_id, place, id FROM (
        SELECT doc_id, place, trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS sentence FROM cut) JOIN known USING (sentence)),
    steps(doc_id, rule, k, place) AS (
        SELECT doc_id, rule, 0, min(place) FROM hits JOIN rules USING (id) WHERE k = 0 GROUP BY doc_id, rule
        UNION ALL
        SELECT s.doc_id, s.rule, s.k + 1, (SELECT min(h.place) FROM hits h WHERE h.doc_id = s.doc_id AND h.id = r.id AND h.place > s.place)
        FROM steps s JOIN rules r ON r.rule = s.rule AND r.k = s.k + 1 WHERE s.place IS NOT NULL),
    done AS (SELECT DISTINCT s.doc_id, r.licence FROM steps s JOIN (SELECT rule, licence, max(k) AS k FROM rules GROUP BY rule, licence) r
        ON s.rule = r.rule AND s.k = r.k WHERE s.place IS NOT NULL),
    kept AS (SELECT doc_id, licence FROM done d WHERE NOT (licence = 'BSD-2-Clause' AND EXISTS (
        SELECT 1 FROM done e WHERE e.doc_id = d.doc_id AND e.licence = 'BSD-3-Clause')))
    SELECT d.doc_id, coalesce(n.n, 0) AS n_sentences, coalesce(l.n, 0) AS n_licences, coalesce(l.licences, '') AS licences
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) n USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(licence, ',' ORDER BY licence) AS licences FROM kept GROUP BY doc_id) l USING (doc_id)
    """
