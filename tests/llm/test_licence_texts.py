"""Standard licence texts and headers as they stand in files, and the SQL statement where its notices are all there is."""

from __future__ import annotations

import pytest

from fleetviews.llm import common, licences
from tests.compare import differences, oracle

MIT = """The MIT License (MIT)

Copyright (c) 2015 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
CONDITIONS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

  * Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer.

  * Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.
"""
BSD3 = CONDITIONS + """
  * Neither the name of the copyright holder nor the names of its
    contributors may be used to endorse or promote products derived from
    this software without specific prior written permission.
"""
GPL3 = """Frobnicate, a tool.
Copyright (C) 2020 Jo Doe

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
ISC = """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
TEXTS = [
    (MIT, "MIT"), (MIT.split("\n\n")[2], "MIT"), ("This project is licensed under the MIT License.", "MIT"),
    (BSD3, "BSD-3-Clause"), (CONDITIONS, "BSD-any"), ("BSD 2-Clause License\n\n" + CONDITIONS, "BSD-2-Clause"),
    (GPL3, "GPL-3.0"), (GPL3.replace("version 3", "version 2"), "GPL-2.0"), (APACHE, "Apache-2.0"), (ISC, "ISC"),
    ("Eclipse Public License 2.0", "EPL-2.0"),
    ("A licence is a permission to do a thing.\n\nThis project is described in the manual.", None),
]


def test_standard_texts(spark):
    whole = [(path.read_text("utf-8"), path.stem) for path in sorted(licences.TEXTS.glob("*.txt"))]
    rows = [*TEXTS, *whole]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licences.scanned(docs, "doc_id").collect()}
    assert [(i, got[i]) for i in range(len(rows))] == [(i, name) for i, (_, name) in enumerate(rows)]


def test_templates_name_one_licence():
    grams = [tuple(g) for _, g in licences.known()]
    assert len(grams) == len(set(grams))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_tables_as_before(spark, folder):
    docs = common.documents(spark, folder)
    key = "doc_id"
    got = licences.scanned(docs, key).drop("key")
    assert differences(got, oracle(folder), licences.OP7_SQL) is None
