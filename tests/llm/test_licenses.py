import duckdb

from inkwell.llm.licenses import TEMPLATES, scan
from inkwell.llm.queries import ORACLES, op8_license_scan


def test_inheritance(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.txt", "words"),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.txt", None),
        ("a/z.txt", "head\n  Licensed under the   Apache License, Version 2.0.  \nfoot"),
        ("LICENSE", "Licensed under CC BY-NC 4.0."),
        ("q/r/s.txt", "A license to kill is a film about licenses and other such things entirely"),
        ("top.txt", ""),
        ("top.txt", ""),
        (None, "MIT License"),
        ("q/long.txt", "x" * 200000 + " license\n" + "y " * 50000),
    ]
    df = spark.createDataFrame([(*r, 3) for r in rows], "path string, text string, license int")
    got = {r.path: (r.own_license, r.license, r.license_dir) for r in scan(df).collect()}
    assert scan(df).count() == len(rows)
    assert got["a/LICENSE"] == ("MIT", "MIT", None) and got["a/b/x.txt"] == (None, "GPL-3.0", "a/b") and got["a/b/c/y.txt"] == (None, "GPL-3.0", "a/b")
    assert got["a/z.txt"][0] == "Apache-2.0" and got["q/r/s.txt"] == (None, "CC-BY-NC-4.0", "") and got["top.txt"] == (None, "CC-BY-NC-4.0", "")
    assert scan(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(f"d/{i}", t) for i, (_, t) in enumerate(TEMPLATES)], "path string, text string")
    assert sorted(r.own_license for r in scan(alone).collect()) == sorted(n for n, _ in TEMPLATES)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    df = op8_license_scan(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.execute(ORACLES["op8_license_scan"])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in rel.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str)
    assert got == want and any(r[names.index("license_dir") if False else 0] is not None for r in got)
    assert df.where("own_license is not null").count() >= 30 and df.where("license is not null and own_license is null").count() > 0


def test_whole_files_and_headers(spark):
    from pathlib import Path

    import inkwell.llm.licenses as module

    text = lambda name: (Path(module.__file__).parent / "license_texts" / f"{name}.txt").read_text()
    apache = [x.strip() for x in text("Apache-2.0").split("Licensed under the Apache License")[1].split("\n")]
    apache = ["Copyright 2019 The Example Authors", "", "Licensed under the Apache License" + apache[0], *apache[1:]]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    mit = "\n\nCopyright (c) 2021 Jane Q. Example\n\n" + text("MIT")
    rows = [
        ("a/LICENSE", "MIT License" + mit, "MIT"),
        ("b/LICENSE.txt", "The MIT License (MIT)" + mit, "MIT"),
        ("c/COPYING", text("GPL-3.0"), "GPL-3.0"),
        ("d/COPYING", text("GPL-2.0"), "GPL-2.0"),
        ("e/LICENSE", text("MPL-2.0"), "MPL-2.0"),
        ("f/LICENSE", text("Apache-2.0"), "Apache-2.0"),
        ("g/LICENSE", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + text("BSD-3-Clause"), "BSD-3-Clause"),
        ("h/LICENSE", text("BSD-2-Clause"), "BSD-2-Clause"),
        ("i/COPYING.LESSER", text("LGPL-3.0"), "LGPL-3.0"),
        ("j/x.py", "#!/usr/bin/env python\n" + "\n".join(f"# {x}".rstrip() for x in apache) + "\nimport os\n", "Apache-2.0"),
        ("k/x.c", "/*\n" + "\n".join(f" * {x}" for x in gpl.split("\n")) + "\n */\nint main() {}\n", "GPL-3.0"),
        ("l/x.go", "// SPDX-License-Identifier: BSD-3-Clause\npackage x\n", "BSD-3-Clause"),
        ("m/x.rs", "// SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0"),
        ("n/x.txt", "A long tale\nof a license to kill and\nother such matters\n", None),
        ("o/LICENSE", "All of it is mine. You may read it on Sundays, after lunch, aloud.\nNot otherwise.", None),
        ("p/LICENSE", "Apache License\nVersion 2.0, January 2004\n\nsee the site", "Apache-2.0"),
        ("a/deep/er/y.txt", "words", None),
    ]
    got = {r.path: (r.own_license, r.license) for r in scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert {p: got[p][0] for p, _, _ in rows} == {p: n for p, _, n in rows}
    assert got["a/deep/er/y.txt"][1] == "MIT"
