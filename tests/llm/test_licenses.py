from fieldsense.llm import licenses as S
from fieldsense.llm.catalog import ORACLE_SQL, QUERIES
from fieldsense.llm.license_texts import NAMES, PHRASES, TEXTS, known

MIT = TEXTS["MIT"]
ROWS = [
    (1, MIT), (2, MIT.upper()), (3, "Copyright (c) 2019 Jane Doe\n" + MIT), (4, MIT.replace(" ", "\n\n")),
    (5, MIT.replace('"', "“").replace("sublicense", "sublicence")), (6, MIT + " Extra."), (7, MIT[:-60]),
    (8, "Some prose.\nReleased under the MIT License.\nMore prose."), (9, "licensed under the apache licence, version 2.0"),
    (10, "Released under the MIT License. And more on the same line."), (11, None), (12, ""), (13, "\n \n"),
    (14, "SPDX-License-Identifier: GPL-3.0\nReleased under the GPLv3\n© 2020 x"), (15, "MIT"),
    (16, "All about Copyright 2020 and law"), (17, "Copyright 2001 A\nCopyright 2002 B"), (None, MIT), (18, MIT), (18, MIT),
    (19, "Licensed under the BSD 3-Clause License\nLicensed under the BSD 3-Clause License"), (20, "É Ünï\tcödé " * 3),
    (21, TEXTS["BSD-3-Clause"].replace("\n", " ")), (22, ("filler line\n" * 20_000) + "Released under the MIT License"),
    (23, "organised colours, judgements and behaviours unauthorised wilful v2 gplv2")]


def test_scan(docs_of, clashing):
    got = {}
    for r in S.license_scan(clashing(docs_of(ROWS))).collect():
        got.setdefault(r.doc_id, []).append((r.license_id, r.notice_ids, r.n_notices))
    for i in (1, 2, 3, 4, 5):
        assert got[i][0][0] == "MIT", i
    assert all(got[i][0][0] is None for i in (6, 7, 8, 11, 12, 13, 15))
    assert got[8] == [(None, "MIT", 1)] and got[9] == [(None, "Apache-2.0", 1)] and got[10] == [(None, "", 0)]
    assert got[14] == [(None, "GPL-3.0", 2)] and got[19] == [(None, "BSD-3-Clause", 2)]
    assert got[18] == [("MIT", "MIT", 1)] * 2 and got[None][0][0] == "MIT" and got[21][0][0] == "BSD-3-Clause"
    assert got[22] == [(None, "MIT", 1)]


def test_scan_is_its_sql(docs_of, in_duckdb, same_rows, spark):
    same_rows(S.license_scan(docs_of(ROWS)).collect(), in_duckdb(ORACLE_SQL["op8_license_scan"], ROWS))
    same_rows(QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.001").collect(), in_duckdb(ORACLE_SQL["op8_license_scan"]))


def test_every_known_text_finds_itself(docs_of):
    rows = [(i, t) for i, (_, _, t) in enumerate(known())]
    got = {r.doc_id: r for r in S.license_scan(docs_of(rows)).collect()}
    for i, (name, kind, _) in enumerate(known()):
        assert (got[i].license_id == name) if kind == "text" else (got[i].notice_ids == name), known()[i]
    assert len(known()) >= len(TEXTS) + len(NAMES) * (len(PHRASES) - 1)


def test_nothing(docs_of):
    assert S.license_scan(docs_of([])).collect() == []


def test_whole_texts_and_usual_forms(docs_of, in_duckdb, same_rows):
    from pathlib import Path
    folder = Path(S.__file__).parent / "license_data"
    body = {i: t.split("\n\n", 1)[1] for i, t in TEXTS.items()}
    want = [(p.stem, p.read_text("utf-8")) for p in sorted(folder.iterdir())]
    whole = dict(want)
    want += [
        ("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2015 Jane Doe\n\n{body['MIT']}"), ("MIT", body["MIT"]),
        ("BSD-3-Clause", f"Copyright (c) 2001, Jane Doe\nAll rights reserved.\n\n{body['BSD-3-Clause']}"),
        ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) 2001, Jane Doe\nAll rights reserved.\n\n"
         + body["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")),
        ("Apache-2.0", whole["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2019 Jane Doe")),
        ("Apache-2.0", whole["Apache-2.0"].split("   APPENDIX:")[0].replace("http:", "https:")),
        ("GPL-2.0", whole["GPL-2.0"].split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n"),
        ("GPL-2.0", whole["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
                                             "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")),
        ("Unlicense", "The Unlicense\n\n" + whole["Unlicense"])]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0"} <= set(whole)
    rows = [(i, t) for i, (_, t) in enumerate(want)] + [(900, whole["GPL-3.0"][:-400]), (901, whole["MPL-2.0"] + "More.")]
    got = S.license_scan(docs_of(rows)).collect()
    ids = {r.doc_id: r.license_id for r in got}
    assert [ids[i] for i in range(len(want))] == [i for i, _ in want]
    assert ids[900] is None and ids[901] is None
    same_rows(got, in_duckdb(ORACLE_SQL["op8_license_scan"], rows))


def test_usual_header_lines(docs_of):
    rows = [(1, '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file'),
            (2, "// SPDX-License-Identifier: GPL-2.0-or-later"), (3, "SPDX-License-Identifier: AGPL-3.0-only")]
    assert {r.doc_id: r.notice_ids for r in S.license_scan(docs_of(rows)).collect()} == {1: "Apache-2.0", 2: "GPL-2.0",
                                                                                          3: "AGPL-3.0"}
