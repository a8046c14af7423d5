"""Licence sentences and rules on small texts."""

import pytest

from segmint.llm import license_scan as ls

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
NAMES = " * Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
NAMES_ONE = " * Neither the name of Foo nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

CASES = [
    ("words before\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("no full stop\nReleased under the MIT License.\nmore", "MIT"),
    (MIT + AS_IS, "MIT"),
    (MIT, ""),  # a rule needs all its sentences
    (BSD, "BSD-2-Clause"),
    (BSD + NAMES_ONE, "BSD-3-Clause"),  # the shorter rule is part of it
    ("This work is licensed under the GNU General Public License, version 3.\n\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,GPL-3.0-only"),
    ("# All rights reserved.", "All-rights-reserved"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, pos string")
    got = {r["doc_id"]: r["licenses"] for r in ls.scan(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_order_counts(spark):
    lines = (BSD.strip() + "\n" + NAMES_ONE).split("\n")
    df = spark.createDataFrame([(1, "\n".join(lines[::-1]))], "doc_id long, text string")
    assert "BSD-3-Clause" not in ls.scan(df).first()["licenses"]


def test_edge_rows(spark):
    note = "Released under the MIT License."
    rows = [(None, note), (1, None), (2, ""), (3, " \n\n"), (4, note), (4, note), (5, (note + " ") * 5000), (6, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in ls.scan(df).collect()}
    assert got == {None: (1, "MIT"), 4: (2, "MIT"), 5: (5000, "MIT")}
    assert ls.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ls.known_sentences(ls.sentence_rows(df), {"bad": "two words"})


def test_notices_in_other_words(spark):
    comment = lambda t: "# Copyright (c) X\n#\n" + "\n".join("# " + x if x else "#" for x in t.split("\n"))
    cases = [
        ("This project is licensed under the MIT License", "MIT"),
        ("It is released under the MIT License, see LICENSE", "MIT"),
        ("// SPDX-License-Identifier: MIT\nint main;", "MIT"),
        ("/* SPDX-License-Identifier: GPL-2.0+ */\n", "GPL-2.0-or-later"),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0\nx", "Apache-2.0,MIT"),
        ("SPDX-License-Identifier: MIT-0\n", "MIT-0"),
        ("Foo is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
        ("The code is under the GNU Affero General Public License v3.", "AGPL-3.0-only"),
        (comment(MIT + AS_IS), "MIT"),
        ("a license for a car", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in ls.scan(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}
