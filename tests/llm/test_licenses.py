from corpus import frame
from panelcast.llm.licenses import SENTENCES, scan_licences


def scan(spark, texts):
    rows = scan_licences(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    return [(r.licences, r.n_matches, r.partial) for r in rows]


def test_named_and_full_licences(spark):
    mit = "\n\n".join(SENTENCES[k].capitalize() + "." for k in ("mit-grant", "mit-as-is", "mit-liability"))
    bsd = [SENTENCES[k] for k in ("bsd-terms", "bsd-source", "bsd-binary", "bsd-endorse")]
    made = scan(
        spark,
        [
            "Some text.\nReleased under the MIT License.",
            "a heading without end\nLicensed under CC BY-NC 4.0.\nReleased under the  mit   license!",
            "Intro. " + mit.replace(" copy ", " copy\n "),
            ". ".join(bsd),
            ". ".join(bsd[:3]),
            bsd[0] + ". Something else. " + bsd[1] + ".",
            "Licensed under the Apache License, Version 2.0.",
            "This work is licensed under the GNU General Public License, version 3.",
        ],
    )
    assert made == [
        (["MIT"], 1, []),
        (["CC-BY-NC-4.0", "MIT"], 2, []),
        (["MIT"], 1, []),
        (["BSD-3-Clause"], 1, []),
        (["BSD-2-Clause"], 1, []),
        ([], 0, ["bsd-terms", "bsd-source"]),
        (["Apache-2.0"], 1, []),
        (["GPL-3.0"], 1, []),
    ]


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL3 = """    Copyright (C) 2020  Some Body

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
BSD2 = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_published_texts(spark):
    texts = [MIT, MIT.split("Body\n\n")[1], APACHE, APACHE.replace("http:", "https:"), GPL3, GPL2, BSD3, BSD2, BSD3.replace("Body\n", "Body. All rights reserved.\n"), BSD3.replace("1.", "*").replace("2.", "*").replace("3.", "*"), 'Licensed under the Apache License, Version 2.0 (the "License").']
    named = [["MIT"], ["MIT"], ["Apache-2.0"], ["Apache-2.0"], ["GPL-3.0-or-later"], ["GPL-2.0-or-later"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-3-Clause"], ["Apache-2.0"]]
    made = scan(spark, texts)
    assert [m[0] for m in made] == named and all(m[2] == [] for m in made)


def test_edges(spark):
    long = "word " * 50_000 + ". Released under the MIT License."
    rows = [None, "", " \n ", "...", "[MIT] <mit-grant>", long, "Released under the MIT License. Released under the MIT License."]
    made = scan(spark, rows)
    assert made[:5] == [([], 0, [])] * 5 and made[5] == (["MIT"], 1, []) and made[6] == (["MIT"], 2, [])
    assert scan(spark, []) == []


def test_plan_has_no_python_and_no_shuffle(spark):
    df = scan_licences(frame(spark, [(1, "x")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
