import pytest
from pyspark.sql import functions as F

from zymolith.sources import configs as C
from zymolith.sources import structures as P
from zymolith.sources import tables as S
from zymolith.sources import text_formats as X


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_fasta_keeps_file_order(spark, tmp_path):
    text = "".join(f">id{k} more\nAC\nD{k}\n\n" for k in range(50))
    rows = X.read_fasta(spark, write(tmp_path / "a.fasta", text)).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(50)) and [r.id for r in rows] == [f"id{k}" for k in range(50)]
    assert rows[7].header == "id7 more" and rows[7].sequence == "ACD7"
    out = f"{tmp_path}/out"
    X.write_fasta(spark.createDataFrame([("a", "AC"), ("b", "D")], "id string, sequence string").coalesce(1), out)
    assert [(r.id, r.sequence) for r in X.read_fasta(spark, out).orderBy("ordinal").collect()] == [("a", "AC"), ("b", "D")]


def test_loose_fasta_opens_at_any_marked_line(spark, tmp_path):
    p = write(tmp_path / "b.fasta", "x >one\nAC\n-D\n>two\nE\n>three\n")
    rows = X.read_fasta_loose(spark, p).orderBy("ordinal").collect()
    assert [(r.header, r.sequence) for r in rows] == [("x one", "AC-D"), ("two", "E"), ("three", "")]


def test_multiline_quoted_csv_with_mark_and_blank_rows(spark, tmp_path):
    p = write(tmp_path / "c.csv", '﻿ID,Amino acid sequence\na,"MK\nLV"\n,\nb,\nc,QQ\n')
    df = S.read_csv(spark, p, complete=[])
    assert df.columns == ["ID", "Amino acid sequence"]
    assert [(r[0], r[1]) for r in df.collect()] == [("a", "MK\nLV"), ("c", "QQ")]


def test_hits_and_profiles(spark, tmp_path):
    p = write(tmp_path / "PF1.txt", "# head\na x PF1 x 1e-9 12.5 0\na x PF1 x 1e-9 10 0\n\nb x y z 1 bad 0\n")
    assert [(r.id, r.score, r.profile) for r in X.read_hits(spark, p).collect()] == [("a", 12.5, "PF1"), ("a", 10.0, "PF1")]
    line = "      1 " + " ".join(["2.5"] * 19 + ["*"]) + "      1 m - - -\n"
    p = write(tmp_path / "h.hmm", "HMMER3/f\nNAME  fam\nACC   PF9.1\nLENG  3\nGA    27.0 26.0;\n" + line + "//\n")
    assert tuple(X.read_profiles(spark, p).first()[1:]) == ("fam", "PF9.1", 3, 27.0)
    r = X.read_profile_scores(spark, p).first()
    assert r.position == 1 and r.scores[0] == 2.5 and r.scores[19] is None


def test_newick():
    assert X.parse_newick("((x:0.1,y:0.3)in:0.2,'z z':1)root;") == [("root", None, None), ("in", "root", 0.2), ("x", "in", 0.1), ("y", "in", 0.3), ("z z", "root", 1.0)]
    assert X.parse_newick("(a,b);")[0] == ("_1", None, None)
    with pytest.raises(ValueError):
        X.parse_newick("((a,b);")


def test_json_hits_and_names(spark, tmp_path):
    for k in "ab":
        write(tmp_path / "hits" / f"{k}.json", '{"isTPS": 0.%d,\n "c": 1}' % (5 + ord(k) - 97))
    rows = S.gathered(S.read_json_hits(spark, str(tmp_path / "hits"), ["isTPS", "c", "none"]), "isTPS").collect()
    assert [(r.id, r.isTPS, r.none) for r in rows] == [("b", 0.6, None), ("a", 0.5, None)]
    assert spark.range(1).select(S.hit_name(F.lit("tr|A/B x y")).alias("n")).first().n == "tr|AB"


def test_fold_store_reads_one_partition(spark, tmp_path):
    p = f"{tmp_path}/folds"
    df = spark.createDataFrame([("a", None, "s", "fold_0"), ("b", "t", "s", "fold_1"), ("c", "u", "s", "unsplittable_targets")], "id string, target string, split string, fold string")
    S.write_folds(df, p)
    got = S.read_fold(spark, p, "s", "fold_0")
    assert got.first().target == "__*missing*__" and "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().toString()
    assert {r.id for r in S.read_folds(spark, p, "s").collect()} == {"a", "b"}


PDB = """HELIX    1   1 ALA A    2  ALA A    3  1                                   2
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 80.00           N
ATOM      2  CA  ALA A   1      12.104   6.134  -6.504  1.00 20.00           C
ATOM      3  N   GLY A   2      13.104   6.134  -6.504  1.00 69.99           N
ATOM      4  CA  GLY A   2A     14.104   6.134  -6.504  1.00 90.00           C
"""


def test_structures(spark, tmp_path):
    p = write(tmp_path / "pdb" / "x1.pdb", PDB)
    atoms = P.read_atoms(spark, p)
    r = atoms.orderBy("serial").collect()
    assert (r[0].file, r[0].atom, r[0].residue, r[0].x, r[0].confidence) == ("x1", "N", 1, 11.104, 80.0) and r[3].insertion == "A"
    assert [(x.residue) for x in P.confident_residues(atoms).collect()] == [1]
    assert sorted(x.residue for x in P.secondary_residues(spark, p).collect()) == [2, 3]
    assert sorted((x.residue, x.x) for x in P.alpha_carbons(atoms).collect()) == [(1, 12.104), (2, 14.104)]
    files = spark.createDataFrame([("a(1)",), ("b",), ("1ps1",)], "file string")
    needed = spark.createDataFrame([("a1",), ("1ps1",)], "id string")
    assert [(x.file, x.clean) for x in P.needed_files(files, needed, files).collect()] == [("a(1)", "a1")]
    P.write_atoms(atoms.withColumn("module_id", F.lit("m")), f"{tmp_path}/out")
    again = P.read_atoms(spark, f"{tmp_path}/out")
    assert sorted((x.serial, x.atom, x.x, x.confidence) for x in again.collect()) == sorted((x.serial, x.atom, x.x, x.confidence) for x in r)


def test_configs(tmp_path):
    write(tmp_path / "base.yaml", "a: 1\nb: None\nspace:\n  - x\n  - y\n")
    p = write(tmp_path / "v" / "main.yaml", "include: ../base.yaml\na: 2.5  # more\nname: 'q: r'\nflag: true\nnested:\n  k: [1, 2]\n")
    assert C.load_config(p) == {"a": 2.5, "b": None, "space": ["x", "y"], "name": "q: r", "flag": True, "nested": {"k": [1, 2]}}
    with pytest.raises(ValueError):
        C.typed(C.Experiment, {"model_type": "m", "nope": 1})
    assert C.Experiment("a", "b") < C.Experiment("a", "c") < C.Experiment("b", "a")
    for d in ("m/v1", "m/v2.ignore", "n.ignore/v", "o/w"):
        (tmp_path / "cfg" / d).mkdir(parents=True)
    assert C.discover(tmp_path / "cfg") == [("m", "v1"), ("o", "w")]


def test_latest_results_fall_back(spark):
    reg = spark.createDataFrame([("f0", "a", 1, "old"), ("f0", "a", 2, "new"), ("all_folds", "a", 9, "folds"), ("f1", "all_classes", 3, "classes")], "fold string, class string, ts int, path string")
    want = spark.createDataFrame([("f0", "a"), ("f1", "a"), ("f1", "b"), ("f9", "z")], "fold string, class string")
    assert {(r["fold"], r["class"]): r.path for r in C.latest_results(reg, want).collect()} == {("f0", "a"): "new", ("f1", "a"): "classes", ("f1", "b"): "classes"}


def test_long_serials_and_residues(spark, tmp_path):
    numbers = [-999, -1, 0, 9999, 10000, 99999, 100000, 1200000, 43770015, 43770016, 87440031, None]
    rows = [(n, None if n is None or n > 2436111 else n, float(k)) for k, n in enumerate(numbers)]
    atoms = spark.createDataFrame(rows, "serial int, residue int, x double").selectExpr("'m' AS module_id", "serial", "'CA' AS atom", "'ALA' AS residue_name", "'A' AS chain", "residue", "'' AS insertion", "x", "x AS y", "x AS z", "90.0D AS confidence")
    P.write_atoms(atoms, f"{tmp_path}/far")
    assert sorted((r.x, r.serial, r.residue) for r in P.read_atoms(spark, f"{tmp_path}/far").collect()) == sorted((x, n, m) for n, m, x in rows)
    assert P.read_atoms(spark, f"{tmp_path}/far").where("x = y and y = z and confidence = 90").count() == len(rows)
    for wrong in ("serial + 87440032 AS serial, x", "serial, x + 100000 AS x"):
        with pytest.raises(Exception, match="no place|too wide"):
            P.write_atoms(atoms.where("serial = 0").drop("serial", "x").crossJoin(spark.sql(f"SELECT {wrong} FROM (SELECT 0 AS serial, 1D AS x)")), f"{tmp_path}/{len(wrong)}")
