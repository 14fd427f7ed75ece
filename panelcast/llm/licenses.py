"""Licence scans: sentences become identifiers, identifier sequences are matched by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences as ``SENTENCE_END`` parts the published texts, lower case, words only; also by lines
#: where a copyright line without a full stop comes before, and whole where a text has no colon or semicolon.
SENTENCES = {
    "mit-named": "released under the mit license",
    "mit-named-2": "licensed under the mit license",
    "mit-named-3": "this project is licensed under the mit license",
    "mit-named-4": "this software is released under the mit license",
    "mit-title": "mit license",
    "mit-title-2": "the mit license",
    "mit-title-3": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-grant-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-grant-line-1": "permission is hereby granted free of charge to any person obtaining a copy",
    "mit-grant-line-2": "of this software and associated documentation files the software to deal",
    "mit-grant-line-3": "in the software without restriction including without limitation the rights",
    "mit-grant-line-4": "to use copy modify merge publish distribute sublicense and or sell",
    "mit-grant-line-5": "copies of the software and to permit persons to whom the software is",
    "mit-grant-line-6": "furnished to do so subject to the following conditions",
    "apache-named": "licensed under the apache license version 2 0",
    "apache-named-2": "this project is licensed under the apache license 2 0",
    "apache-named-3": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-copy-as-is": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-copy-as-is-2": "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-named": "this work is licensed under the gnu general public license version 3",
    "gpl3-named-2": "this program is licensed under the gnu general public license version 3",
    "gpl3-named-3": "licensed under the gnu general public license version 3",
    "gpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-free": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3-either": "either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-either": "either version 2 of the license or at your option any later version",
    "gpl-hope-1": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-hope-2": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-named": "licensed under cc by 4 0",
    "cc-by-sa-named": "licensed under cc by sa 4 0",
    "cc-by-nc-named": "licensed under cc by nc 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-terms-line-1": "redistribution and use in source and binary forms with or without",
    "bsd-terms-line-2": "modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}

#: Rules in order of trial; each is a licence and the identifiers that must follow one another;
#: ``-`` is one unknown sentence, such as the number of a clause.
RULES = (
    ("MIT", ("mit-grant", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant-1", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant-line-1", "mit-grant-line-2", "mit-grant-line-3", "mit-grant-line-4", "mit-grant-line-5", "mit-grant-line-6", "mit-notice", "mit-as-is", "mit-liability")),
    ("Apache-2.0", ("apache-named-3", "apache-comply", "apache-copy-as-is", "apache-see")),
    ("Apache-2.0", ("apache-named-3", "apache-comply", "apache-copy-as-is-2", "apache-see")),
    ("Apache-2.0", ("apache-named", "apache-comply", "apache-copy-as-is", "apache-see")),
    ("Apache-2.0", ("apache-named", "apache-comply", "apache-copy-as-is-2", "apache-see")),
    ("Apache-2.0", ("apache-named-3", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-named", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope-1", "gpl-hope-2", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl3-either", "gpl-hope-1", "gpl-hope-2", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl-hope-1", "gpl-hope-2", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-either", "gpl-hope-1", "gpl-hope-2", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl3-either")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-either")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-see")),
    ("BSD-3-Clause", ("bsd-terms", "-", "bsd-source", "-", "bsd-binary", "-", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-terms-line-1", "bsd-terms-line-2", "-", "bsd-source", "-", "bsd-binary", "-", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-terms-line-1", "bsd-terms-line-2", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-terms", "-", "bsd-source", "-", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-terms-line-1", "bsd-terms-line-2", "-", "bsd-source", "-", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-terms-line-1", "bsd-terms-line-2", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-terms", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("MIT", ("mit-named",)),
    ("MIT", ("mit-named-2",)),
    ("MIT", ("mit-named-3",)),
    ("MIT", ("mit-named-4",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-2",)),
    ("MIT", ("mit-title-3",)),
    ("Apache-2.0", ("apache-named",)),
    ("Apache-2.0", ("apache-named-2",)),
    ("Apache-2.0", ("apache-named-3",)),
    ("GPL-3.0", ("gpl3-named",)),
    ("GPL-3.0", ("gpl3-named-2",)),
    ("GPL-3.0", ("gpl3-named-3",)),
    ("CC-BY-4.0", ("cc-by-named",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-named",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-named",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
)

SENTENCE_END = r"[.!?:;]+([ \t\r\n]+|\z)"


def normalised(sentence: Column) -> Column:
    """ASCII letters and digits in lower case, all else one space."""
    return F.btrim(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of a text's sentences in order; ``-`` for one that is not known.

    A sentence that is not known as a whole is tried line by line.
    """
    known = F.create_map(*[F.lit(x) for name, words in sentences.items() for x in (words, name)])

    def named(part: Column) -> Column:
        return F.coalesce(F.element_at(known, normalised(part)), F.lit("-"))

    def by_line(part: Column) -> Column:
        whole = named(part)
        return F.when((whole != "-") | ~F.contains(part, F.lit("\n")), F.array(whole)).otherwise(F.transform(F.split(part, "\n", -1), named))

    return F.flatten(F.transform(F.split(text, SENTENCE_END, -1), by_line))


def scan_licences(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: (id, licences, n_matches, partial).

    ``licences``: sorted distinct licences whose rules match; ``n_matches``: matches of all rules; ``partial``:
    known sentences that no rule used, in order. Rules are tried in their order and use up the sentences they
    match; an unknown sentence in between breaks a match, unless a rule has it as ``-``. The two tables are parameters of fixed size. A null
    or empty text has no licences; repeated rows give repeated results; other columns are not read. All work
    is in built-in functions of one scan without a shuffle.
    """
    ids = F.filter(sentence_ids(F.coalesce(F.col(text_column), F.lit("")), sentences), lambda x: x.isNotNull())
    tagged = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    rows = docs.select(F.col(id_column), tagged.alias("tags"))
    tags = F.col("tags")
    for licence, sequence in rules:
        tags = F.replace(tags, F.lit("".join(f"<{x}>" for x in sequence)), F.lit(f"[{licence}]"))
    rows = rows.select(id_column, tags.alias("tags"))
    found = F.regexp_extract_all("tags", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    rest = F.filter(F.regexp_extract_all("tags", F.lit("<([^>]+)>"), F.lit(1)), lambda x: x != "-")
    return rows.select(id_column, F.array_sort(F.array_distinct(found)).alias("licences"), F.size(found).cast("long").alias("n_matches"), rest.alias("partial"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licences_sql(sentences: dict[str, str] = SENTENCES, rules=RULES, source: str = "documents") -> str:
    """DuckDB SQL for ``scan_licences`` with lists joined by commas: unnested sentences, joined with a table of names."""
    names = ", ".join(f"({_text(w)}, {_text(n)})" for n, w in sentences.items())
    tags = "tags"
    for licence, sequence in rules:
        tags = f"replace({tags}, {_text(''.join(f'<{x}>' for x in sequence))}, {_text(f'[{licence}]')})"
    norm = "trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')))"
    return f"""
WITH known(words, name) AS (VALUES {names}),
parts AS (
  SELECT doc_id, row_number() OVER () AS r, string_split_regex(coalesce(text, ''), '{SENTENCE_END}') AS p FROM {source}),
sentences AS (SELECT doc_id, r, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM parts),
whole AS (SELECT s.*, k.name FROM sentences s LEFT JOIN known k ON k.words = {norm.format('s.s')}),
lines AS (
  SELECT doc_id, r, i, 1 AS j, coalesce(name, '-') AS name FROM whole WHERE name IS NOT NULL OR NOT contains(s, chr(10))
  UNION ALL
  SELECT doc_id, r, i, j, coalesce(k.name, '-') FROM (
    SELECT doc_id, r, i, generate_subscripts(string_split(s, chr(10)), 1) AS j, unnest(string_split(s, chr(10))) AS l
    FROM whole WHERE name IS NULL AND contains(s, chr(10))) x LEFT JOIN known k ON k.words = {norm.format('x.l')}),
joined AS (SELECT doc_id, r, string_agg('<' || name || '>', '' ORDER BY i, j) AS tags FROM lines GROUP BY doc_id, r),
matched AS (SELECT doc_id, {tags} AS tags FROM joined)
SELECT doc_id,
  array_to_string(list_sort(list_distinct(regexp_extract_all(tags, '\\[([^\\]]+)\\]', 1))), ',') AS licences,
  len(regexp_extract_all(tags, '\\[([^\\]]+)\\]', 1))::BIGINT AS n_matches,
  array_to_string(list_filter(regexp_extract_all(tags, '<([^>]+)>', 1), lambda x: x <> '-'), ',') AS partial
FROM matched"""
