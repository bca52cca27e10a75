"""Classes of equal hashes are told apart, and long templates found in paragraphs."""

from pyspark.sql import functions as F

from bidloom.llm import licenses
from bidloom.llm.common import apart, rekeyed


def test_equal_keys_with_other_checks_part(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 11, "c"), (2, 5, "d"), (None, 3, "e"), (None, 4, "f")], "node long, high long, x string")
    got = {r.x: r.node for r in rekeyed(df, apart(df)).collect()}
    assert got["a"] == got["b"] == 1 and got["c"] not in (1, 2, None) and got["d"] == 2 and got["e"] is got["f"] is None
    assert apart(df.filter(F.col("x") != "c")) is None


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files, to deal in the Software without restriction.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_whole_paragraphs_meet_long_templates(spark):
    made = [(1, MIT), (2, MIT.split("\n\n")[1].replace(". IN", ".\n\nIN")), (3, MIT.replace("\n", "\r\n")), (4, "İSTANBUL Kil cc by")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[1].labels == got[3].labels == "mit-disclaimer,mit-text" and got[2].labels == ""
    assert got[4].labels == "cc-by" and got[4].first_word == 2


GRANT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU %sGeneral Public License as published by
the Free Software Foundation, either version %s of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU %sGeneral Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."""
HEADERS = {
    1: (GRANT % ("", "3", ""), "gnu-disclaimer,gpl,gpl-3.0-grant"), 2: (GRANT % ("Lesser ", "3", "Lesser "), "gnu-disclaimer,gpl,lgpl-3.0,lgpl-3.0-grant"),
    3: (GRANT % ("Affero ", "3", "Affero "), "agpl-3.0,agpl-3.0-grant,gnu-disclaimer,gpl"), 4: (GRANT % ("", "2", ""), "gnu-disclaimer,gpl,gpl-2.0-grant"),
    5: (GRANT.replace("program", "library") % ("Lesser ", "2.1", "Lesser "), "gnu-disclaimer,gpl,lgpl-2.1,lgpl-2.1-grant"), 6: (BSD, "bsd"), 7: (MPL, "mpl-2.0"), 8: ("Released under the BSD license.", ""),
    9: ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0-text"), 10: ("Licensed under CC BY 4.0.", "cc-by"),
    11: ("Licensed under the GNU Affero General Public License version 3.\nLicensed under the GNU General Public License version 3.", "agpl-3.0,gpl,gpl-3.0"), 12: ("Affero\n\nLicensed under the GNU General Public License version 3.", "gpl,gpl-3.0"), 13: (None, ""), 14: ("", ""),
}


def test_headers_get_their_own_labels_only(spark, tmp_path):
    import duckdb

    made = [(k, f"# {k}\n\n{text}\n\nx = 1" if text and k < 8 else text) for k, (text, _) in HEADERS.items()]
    made += [(k + 100, text.replace("\n", "\r\n * ").replace("\r\n * \r\n", "\r\n\r\n")) for k, text in made if text and k < 8]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in licenses.scan(docs).collect()}
    assert {k: v[6] for k, v in got.items()} == {k: HEADERS[k % 100][1] for k, _ in made}
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    said = {r[0]: r for r in con.sql(licenses.OP10_SQL).fetchall()}
    assert said.keys() == got.keys() and all(said[k][:7] == got[k][:7] and abs(said[k][7] - got[k][7]) < 1e-12 for k in got)
