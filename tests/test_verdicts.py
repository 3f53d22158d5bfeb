"""Flag or pass on a folder of texts with verdicts: a folder for each rule, files with ``# expected:``. The folder is named in LUCIDTEXT_VERDICTS."""

import os
from pathlib import Path

import pytest

from lucidtext.operators import rules
from lucidtext.operators.annotate import Annotated

FOLDER = os.environ.get("LUCIDTEXT_VERDICTS", "")


def read():
    for file in sorted(Path(FOLDER).glob("*/*.txt")) if FOLDER else ():
        lines = file.read_text(encoding="utf-8").split("\n")
        n = next((k for k, line in enumerate(lines) if line.strip() and not line.startswith("#")), len(lines))
        said = [line.split(":", 1)[1].strip() for line in lines[:n] if line.lower().startswith("# expected:")]
        if said and file.parent.name in rules.RULES:
            yield file.parent.name, file.name, said[0], "\n".join(lines[n:]).strip()


CASES = list(read())


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, c[3]) for k, c in enumerate(CASES)], "doc_id long, text string")
    return {(r.doc_id, r.rule) for r in rules.violations(Annotated(docs)).select("doc_id", "rule").distinct().collect()}


@pytest.mark.skipif(not CASES, reason="no folder of verdicts")
@pytest.mark.parametrize("k", range(len(CASES)), ids=[f"{c[0]}-{c[1]}" for c in CASES])
def test_verdict(found, k):
    assert ((k, CASES[k][0]) in found) == (CASES[k][2] == "flag")
