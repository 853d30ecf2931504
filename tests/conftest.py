import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from taxalign.session import local_session

    session = local_session(4, "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def checklist(spark):
    """Rows `id name author rank status parent accepted` -> checklist table."""
    fields = "taxonID canonicalName scientificNameAuthorship taxonRank taxonomicStatus parentNameUsageID acceptedNameUsageID".split()

    def build(text: str):
        rows = []
        for i, line in enumerate(x for x in text.strip().splitlines() if x.strip()):
            cells = [c.strip() for c in line.split("|")] + [""] * 7
            rows.append((i, *cells[:7]))
        return spark.createDataFrame(rows, "_ord bigint, " + ", ".join(f"{f} string" for f in fields))

    return build
