import json

import pytest

from khatasort import cli
from khatasort.sources import models

STATEMENT = """date,direction,counterparty,transaction_id,type,amount
2026-01-02,Paid to,Sun Kirana,T1,DEBIT,10
2026-01-03,Paid to,Asha Verma,T2,DEBIT,20
2026-01-04,Paid to,Zzq Blorp Holdings,T3,DEBIT,30
"""


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "in.csv").write_text(STATEMENT, encoding="utf-8")
    return tmp_path


def run(capsys, *arguments):
    code = cli.main(list(map(str, arguments)))
    return code, capsys.readouterr().out.strip()


def test_statement_commands(folder, capsys):
    store = ("--store", folder / "store")
    assert json.loads(run(capsys, "categorize", folder / "in.csv", "-o", folder / "out", *store)[1])["classified"] == 3
    assert json.loads(run(capsys, "import", folder / "in.csv", *store)[1])["added"] == 3
    assert json.loads(run(capsys, "correct", "Asha Verma", "food", *store)[1]) == {"updated": 1}
    assert json.loads(run(capsys, "classify", "asha verma", *store)[1])["source"] == "USER_OVERRIDE"
    assert "Zzq Blorp Holdings" in run(capsys, "review", *store)[1]
    assert json.loads(run(capsys, "merchants", folder / "in.csv", "-o", folder / "map", *store)[1])["merchants"] == 3
    code, shown = run(capsys, "report", folder / "in.csv", "--json", folder / "r.json", *store)
    assert code == 0 and "transactions 3" in shown and json.loads((folder / "r.json").read_text())["totals"]["transactions"] == 3


def test_evaluation_commands(folder, capsys):
    assert run(capsys, "label-sheet", folder / "in.csv", "-o", folder / "sheet")[0] == 0
    (folder / "labels.csv").write_text("key,flow,true_category\nsun kirana,OUT,groceries\nasha verma,OUT,HEALTH\n", encoding="utf-8")
    code, out = run(capsys, "evaluate", folder / "in.csv", folder / "labels.csv", "--store", folder / "s2")
    assert code == 0 and json.loads(out)["score"]["accuracy"] == 0.5
    assert run(capsys, "categories")[1].splitlines()[0] == "GROCERIES"


def test_mistakes_end_with_2(folder, capsys):
    assert run(capsys, "import", folder / "none.csv", "--store", folder / "s")[0] == 2
    assert run(capsys, "correct", "x", "no such", "--store", folder / "s")[0] == 2
    (folder / "bad.csv").write_text("colour,size\nred,1\n")
    assert run(capsys, "import", folder / "bad.csv", "--store", folder / "s")[0] == 2


def test_downloads_are_checked(tmp_path):
    source = tmp_path / "model.bin"
    source.write_bytes(b"weights")
    digest = models.sha256_of(source)
    got = models.fetch(source.as_uri(), str(tmp_path / "out"), digest)
    assert got.read_bytes() == b"weights"
    with pytest.raises(models.ChecksumError):
        models.fetch(source.as_uri(), str(tmp_path / "other"), "0" * 64)
    assert not list((tmp_path / "other").iterdir())
