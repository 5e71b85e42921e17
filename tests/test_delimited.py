"""Landing files with differing headers and damaged lines."""

from __future__ import annotations

from collections import Counter

import pytest

from fluxora.sources import lake
from fluxora.sources.delimited import scan


def put(root, name, text, encoding="utf-8"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))


def motives(found):
    return Counter((r["arquivo"].rsplit("/", 1)[1], r["linha"], r["motivo"]) for r in found.rejected.collect())


@pytest.fixture()
def lake_root(tmp_path):
    put(tmp_path, "ano=2026/mes=01/a.csv", "Período;Salário;Horas\n202601;10;44\n202601;11;40\n")
    put(tmp_path, "ano=2026/mes=02/b.csv", "salario;periodo;horas;extra\r\n20;202602;44;x\r\n21;202602;40;\r\n")
    put(tmp_path, "ano=2026/mes=03/c.csv", '"horas";"salario";"periodo"\n"30";"3;0";"202603"\n\n')
    put(tmp_path, "ano=2026/mes=04/d.csv", "período;salário;horas\n202604;é;1\n", "latin-1")
    return tmp_path


def test_columns_follow_their_names(spark, lake_root):
    found = scan(spark, str(lake_root), ["periodo", "salario"])
    rows = found.rows.select("ano", "mes", "periodo", "salario", "horas", "extra").collect()
    assert Counter(map(tuple, rows)) == Counter([
        (2026, 1, "202601", "10", "44", None), (2026, 1, "202601", "11", "40", None),
        (2026, 2, "202602", "20", "44", "x"), (2026, 2, "202602", "21", "40", None),
        (2026, 3, "202603", "3;0", "30", None), (2026, 4, "202604", "é", "1", None),
    ])
    assert found.rejected.count() == 0
    assert found.strict.count() == 6
    assert found.rows.groupBy("mes").count().count() == 4


def test_bad_lines_are_set_aside(spark, lake_root):
    put(lake_root, "ano=2026/mes=05/e.csv", b"periodo;salario;horas\n" + b"1;2;3\n" * 120 + b"4;5\n6;7;8;9\n\xe9;1;2\n;;\n\n7;8;9")
    found = scan(spark, str(lake_root))
    bad = motives(found)
    assert bad == Counter([("e.csv", "4;5", "short"), ("e.csv", "6;7;8;9", "long"), ("e.csv", "�;1;2", "undecodable")])
    # Clean and rejected lines are all data lines, whatever columns are asked for.
    assert found.rows.count() == 6 + 122
    assert found.rows.select("salario").where("mes = 5").count() == 122
    with pytest.raises(Exception, match="line in"):
        found.strict.collect()


def test_files_that_cannot_be_read_are_named(spark, lake_root):
    put(lake_root, "x/empty.csv", b"")
    put(lake_root, "x/comma.csv", "periodo,salario\n1,2\n")
    put(lake_root, "x/lacking.csv", "periodo;horas\n1;2\n")
    put(lake_root, "x/twice.csv", "periodo;Período;salario\n1;2;3\n")
    put(lake_root, "x/unnamed.csv", "periodo;;salario\n1;2;3\n")
    put(lake_root, "x/blank.csv", "\nperiodo;salario\n1;2\n")
    found = scan(spark, str(lake_root), ["periodo", "salario"])
    refused = {r["path"].rsplit("/", 1)[1]: r["recusa"] for r in found.files.collect() if r["recusa"]}
    assert refused == {
        "empty.csv": "empty", "comma.csv": "separator", "lacking.csv": "missing:salario",
        "twice.csv": "duplicate_column", "unnamed.csv": "unnamed_column", "blank.csv": "no_header",
    }
    assert found.rows.count() == 6
    with pytest.raises(ValueError, match="lacking.csv|comma.csv|empty.csv"):
        _ = found.strict
    both = scan(spark, str(lake_root), ["periodo", "salario"], separators=(";", ","))
    assert both.rows.count() == 7
    nothing = scan(spark, str(lake_root / "x"), ["outra"])
    assert nothing.rows.columns == ["outra"] and nothing.rows.count() == nothing.rejected.count() == 0


def test_only_some_files(spark, lake_root):
    files = scan(spark, str(lake_root)).files
    some = scan(spark, str(lake_root), only=files.filter("path LIKE '%mes=02%'"))
    assert {r["periodo"] for r in some.rows.collect()} == {"202602"}


def test_read_delimited_is_strict(spark, lake_root):
    assert lake.read_delimited(spark, str(lake_root)).count() == 6
    put(lake_root, "ano=2026/mes=06/f.csv", "periodo;salario\n1;2;3\n")
    with pytest.raises(Exception, match="long line in"):
        lake.read_delimited(spark, str(lake_root)).collect()
