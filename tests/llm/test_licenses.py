import duckdb

from cortexlake.llm.licenses import NAMES, REFERENCES, RULES, SENTENCES, license_scan, oracle

from tests.llm.helpers import DATA, documents, none_of, odd_documents


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, licenses, n_sentences, sentences FROM ({oracle()})").fetchall())
    got = sorted(map(tuple, license_scan(documents(spark)).collect()))
    assert got == want and any(r[1] for r in got)


def test_every_rule_matches_its_sentences_in_order(spark):
    text = {v: k for k, v in (REFERENCES | SENTENCES).items()}
    rows = [(i, "Words before.\n" + ". ".join(text[x].capitalize() for x in rule) + ".", name) for i, (name, rule) in enumerate(RULES)]
    back = [(len(rows), ". ".join(text[x] for x in ("bsd-binary", "bsd-source", "bsd-grant")), "")]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows + back, "doc_id long, text string, licenses string")).collect()}
    assert got == {i: name for i, _, name in rows + back}


def test_odd_rows_and_nothing(spark):
    out = license_scan(odd_documents(spark))
    assert out.count() == odd_documents(spark).count() and out.filter("licenses != ''").count() == 0
    assert license_scan(none_of(documents(spark))).count() == 0


MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_verbatim_texts_wrapped_and_in_comments(spark):
    texts = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (ISC, "ISC"), (MPL, "MPL-2.0"), (GPL.format(":", ",", 3), "GPL-3.0"), (GPL.format(";", ";", 2), "GPL-2.0")]
    rows = []
    for text, name in texts:
        for mark in ("", "# ", " * ", "// ", ";; "):
            rows.append((len(rows), "".join(f"{mark}{x}\n" for x in text.splitlines()), name))
        rows.append((len(rows), text.replace("\n", "\r\n"), name))
        rows.append((len(rows), " ".join(text.split()).replace("MIT License ", "MIT License. ").replace("Author ", "Author. "), name))
    rows.append((len(rows), ISC.replace("any\n", "any\n\n"), ""))
    rows.append((len(rows), "Not " + ISC, ""))
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()}
    assert got == {i: name for i, _, name in rows}


def test_further_licenses_as_their_notices_are_written(spark):
    texts = {
        "LGPL-2.1": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU""",
        "AGPL-3.0": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Affero General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
        "Zlib": """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:""",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. See the file.",
    }
    df = spark.createDataFrame([(k, v) for k, v in enumerate(texts.values())], "doc_id long, text string")
    assert [r.licenses for r in license_scan(df).orderBy("doc_id").collect()] == list(texts)


NAMES_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def test_notices_side_by_side_and_sentences_inside_a_notice(spark):
    texts = {
        BSD + "\n\nAnother part:\n\n" + BSD + NAMES_CLAUSE: "BSD-2-Clause,BSD-3-Clause",
        BSD + NAMES_CLAUSE: "BSD-3-Clause",
        BSD + NAMES_CLAUSE + "\n\n" + BSD: "BSD-2-Clause,BSD-3-Clause",
        "MIT License\n\nCopyright 2020 A. Author.\nAll rights reserved.\n\n" + MIT.split("Author\n\n")[1]: "All-Rights-Reserved,MIT",
        MIT.replace("following conditions:\n", "following conditions:\n\nAll rights reserved.\n"): "All-Rights-Reserved,MIT",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licenses for r in license_scan(df).orderBy("doc_id").collect()] == list(texts.values())


def test_named_licenses_and_tags_as_written(spark):
    rows = [(k, f"// SPDX-License-Identifier: {name}\nint x;", name) for k, name in enumerate(NAMES)]
    said = [("This file is licensed under the Eclipse Public License v2.0.", "EPL-2.0"), ("Released under the Mozilla Public License, Version 2.0.\n", "MPL-2.0"), ("# Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("It is licensed under the MIT licence", ""), ("Distributed under\n * the Zlib License.", "Zlib"), ("Available under the Unlicense; see there.", "Unlicense")]
    rows += [(1000 + k, *x) for k, x in enumerate(said)]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()}
    assert len(NAMES) >= 60 and got == {i: name for i, _, name in rows}
