"""Licence files as they are distributed."""

import textwrap
from pathlib import Path

from stratalake.llm import licenses

TEXTS = Path(licenses.__file__).parent / "license_texts"


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n"))


def test_files_as_distributed(spark):
    mit, isc = licenses.KNOWN[4][1], licenses.KNOWN[5][1]
    bsd = (TEXTS / "BSD-3-Clause.txt").read_text()
    holder = bsd.replace("REGENTS", "COPYRIGHT HOLDERS").replace("the University", "Some Firm Ltd.").replace("The Regents of the University of California", "2019, Some Firm Ltd.").replace("1. R", "* R").replace("2. R", "* R").replace("3. N", "* N")
    apache = (TEXTS / "Apache-2.0.txt").read_text()
    want = {
        "MIT License\n\nCopyright (c) 2026 somebody\n\n" + wrapped(mit, 78): "MIT",
        "The MIT License (MIT)\r\n=====\r\nCopyright © 2020 A B\r\n" + wrapped(mit, 60).replace("\n", "\r\n"): "MIT",
        "ISC License\n\nCopyright 2021 A B <a@b.c>\n\n" + wrapped(isc, 78): "ISC",
        "ISC License\n\n" + isc.replace("above copyright notice", "above\ncopyright notice"): "ISC",
        "BSD 3-Clause License\n\n" + holder: "BSD-3-Clause",
        apache.replace("[yyyy] [name of copyright owner]", "2020 A B"): "Apache-2.0",
        apache[: apache.index("END OF TERMS")]: "Apache-2.0",
        "MIT License\n\nSome prose on the license.": None,
        "The software is under the terms of no license at all.\n" + mit: None,
        "MIT License": None,
        "": None,
    } | {p.read_text(): p.stem for p in TEXTS.glob("*.txt")}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(df, licenses.registry(spark)).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())
    assert len({p.stem for p in TEXTS.glob("*.txt")}) >= 15
