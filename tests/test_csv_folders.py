"""CSV folders whose files differ in their headers, and malformed lines."""

import gzip
import os

import pytest

from tapflow.sources import readers

ROUTE_HEADER = "service,direction,BusStopCode,BusStopSequence,km,dt_from,dt_to"


def write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + ("\n" if lines else ""))


def routes(spark, path, **kw):
    rows = readers.read_routes_csv(spark, path, **kw).collect()
    return sorted(((r.service, r.direction, r.stop, r.seq, r.km) for r in rows), key=str)


def test_files_of_a_folder_are_read_by_their_own_headers(spark, tmp_dir):
    write(tmp_dir, "a.csv", ROUTE_HEADER, "2,1,3,1,0.5,01/02/2017,28/02/2017", "2,1,77,2,1.5,01/02/2017,28/02/2017")
    # another order, a surplus column in the middle, a byte order mark, blanks in the header
    write(tmp_dir, "b.csv", "﻿direction,service, BusStopSequence ,note,BusStopCode,dt_to,dt_from,km",
          '2,9,1,"x, y",1099,28/02/2017,01/02/2017,0.25', "", "2,9,2,,42,28/02/2017,01/02/2017,")
    with gzip.open(f"{tmp_dir}/c d%.csv.gz", "wt") as f:
        f.write("km,dt_from,dt_to,service,direction,BusStopCode,BusStopSequence\n7.5,01/02/2017,28/02/2017,G,1,5,4\n")
    write(tmp_dir, "empty.csv")
    write(tmp_dir, "header_only.csv", ROUTE_HEADER + ",more")
    write(tmp_dir, "same_as_a.csv", ROUTE_HEADER, "A,1,8,1,,01/02/2017,28/02/2017")
    headers = readers.csv_headers(spark, tmp_dir)
    assert sorted(len(files) for files in headers.values()) == [1, 1, 1, 2]
    assert routes(spark, tmp_dir) == sorted(
        [("2", 1, "00003", 1, 0.5), ("2", 1, "00077", 2, 1.5), ("9", 2, "01099", 1, 0.25), ("9", 2, "00042", 2, None),
         ("G", 1, "00005", 4, 7.5), ("A", 1, "00008", 1, None)], key=str)
    # one scan for each header, not for each file
    plan = readers.read_routes_csv(spark, tmp_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 4
    write(tmp_dir, "short.csv", "service,direction", "1,1")
    with pytest.raises(ValueError, match="short.csv: no column BusStopCode"):
        readers.read_routes_csv(spark, tmp_dir)
    write(f"{tmp_dir}/none", "x.csv")
    with pytest.raises(ValueError, match="no file with a header"):
        readers.read_routes_csv(spark, f"{tmp_dir}/none")


def test_malformed_lines_are_seen(spark, tmp_dir):
    good, few, many = ("S,1,3,1,0.5,01/02/2017,28/02/2017", "S,1,4,2", "S,1,5,3,0.5,01/02/2017,28/02/2017,7")
    write(tmp_dir, "a.csv", ROUTE_HEADER, good, few, many, "S,x,6,4,0.5,01/02/2017,28/02/2017")
    write(tmp_dir, "b.csv", "note," + ROUTE_HEADER, "?,T,1,9,1,z,01/02/2017,28/02/2017", good)
    assert routes(spark, tmp_dir) == sorted([("S", 1, "00003", 1, 0.5), ("S", None, "00006", 4, 0.5),
                                             ("T", 1, "00009", 1, None)], key=str)
    kept = routes(spark, tmp_dir, malformed="keep")
    assert len(kept) == 6 and ("S", 1, "00004", 2, None) in kept and ("S", 1, "00005", 3, 0.5) in kept
    with pytest.raises(Exception, match="malformed line in"):
        routes(spark, tmp_dir, malformed="fail")
    with pytest.raises(ValueError):
        routes(spark, tmp_dir, malformed="other")
    schema = readers.T.StructType([readers.T.StructField(c, t) for c, t in [
        ("service", readers.T.StringType()), ("direction", readers.T.IntegerType()), ("km", readers.T.DoubleType())]])
    bad = readers.rejects(spark, tmp_dir, schema)
    assert bad.count() == 5  # columns pruned by the count are still parsed
    found = {(r[readers.MALFORMED], tuple(r.bad_columns), os.path.basename(r[readers.FILE])) for r in bad.collect()}
    assert {(line, file) for line, _, file in found if line} == {(few, "a.csv"), (many, "a.csv"), (good, "b.csv")}
    assert {f[1:] for f in found if not f[0]} == {(("direction",), "a.csv"), (("km",), "b.csv")}


def test_inferred_types_of_a_folder_are_united(spark, tmp_dir):
    write(tmp_dir, "a.csv", "n,x,t", "1,2,a", "3,4,b")
    write(tmp_dir, "b.csv", "t,extra,x,n", "007,true,2.5,5000000000")
    df = readers.read_csv_inferred(spark, tmp_dir)
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("t", "string"), ("extra", "boolean")]
    assert sorted(map(tuple, df.collect())) == [(1, 2.0, "a", None), (3, 4.0, "b", None), (5000000000, 2.5, "007", True)]
