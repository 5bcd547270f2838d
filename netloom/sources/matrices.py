"""Matrix files: the AEM binary layout, and CSV trip lists. An OMX (HDF5) file needs an HDF5 library, which is optional."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.graph import reachable_package
from netloom.operators.matrix import KEYS, cores_of, from_trip_list, nan_to_zero, nonzero

# The layout of an AEM file, version 1.
# offset 0 version uint8, 1 compressed uint8, 2 cells uint64, 10 zones uint32, 14 cores uint8, 15 indices uint8, 16 data class uint8,
# 17 data size uint8, 18 name S20, 38 description S144, 182 core names S50, then index names S20, indices uint64, cells.
NAME, DESCRIPTION, CORE, INDEX, HEADER = 20, 144, 50, 20, 182
INTEGER, FLOATING = 0, 1


def decode(content: bytes, index: int = 0) -> pd.DataFrame:
    """(origin, destination, core columns) of all cells that aren't 0 in every core; NaN counts as 0."""
    at = lambda kind, offset, n=1: np.frombuffer(content, dtype=kind, count=n, offset=offset)
    if int(at("u1", 1)[0]):
        raise ValueError("compressed AEM files are not supported")
    zones, (cores, indices, data, size) = int(at("<u4", 10)[0]), at("u1", 14, 4).tolist()
    if size not in (1, 2, 4, 8) or data not in (INTEGER, FLOATING) or data == FLOATING and size == 1:
        raise ValueError(f"cells of class {data} and {size} bytes are not supported")
    names = [x.decode() for x in at(f"S{CORE}", HEADER, cores)]
    offset = HEADER + CORE * cores + INDEX * indices
    zone = at("<u8", offset, zones * indices).reshape(zones, indices)[:, index].astype(np.int64)
    cube = np.nan_to_num(at(f"<{'i' if data == INTEGER else 'f'}{size}", offset + 8 * zones * indices, zones * zones * cores).reshape(zones, zones, cores).astype(float))
    o, d = np.nonzero(cube.any(axis=2))
    return pd.DataFrame({"origin": zone[o], "destination": zone[d]} | {n: cube[o, d, k] for k, n in enumerate(names)})


def encode(cells: pd.DataFrame, cores: list[str], name: str = "", description: str = "") -> bytes:
    """An AEM file of (origin, destination, cores): 64-bit floats, one index."""
    zone = np.unique(np.concatenate([cells["origin"], cells["destination"]]).astype(np.int64))
    if any(len(c.encode()) > CORE for c in cores):
        raise ValueError(f"core names have {CORE} bytes at most")
    cube = np.zeros((len(zone), len(zone), len(cores)))
    cube[np.searchsorted(zone, cells["origin"]), np.searchsorted(zone, cells["destination"])] = cells[cores].to_numpy(float)
    text = lambda s, n: s.encode()[:n].ljust(n, b"\0")
    head = bytes([1, 0]) + np.uint64(cube.size).tobytes() + np.uint32(len(zone)).tobytes() + bytes([len(cores), 1, FLOATING, 8])
    return head + text(name, NAME) + text(description, DESCRIPTION) + b"".join(text(c, CORE) for c in cores) + text("main_index", INDEX) + zone.astype("<u8").tobytes() + cube.tobytes()


def read_aem(spark: SparkSession, path: str, cores: list[str]) -> DataFrame:
    """One file for each task: (path, origin, destination, *cores). The cores are named, so that the schema needs no scan."""
    reachable_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                found = decode(bytes(content))
                yield found[["origin", "destination", *cores]].assign(path=p)[["path", "origin", "destination", *cores]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, origin long, destination long" + "".join(f", `{c}` double" for c in cores))


def read_matrix(spark: SparkSession, path: str, cores: list[str] | None = None) -> DataFrame:
    """By suffix: .aem, .csv (origin, destination, cores) or a Parquet table."""
    if path.endswith(".aem"):
        return read_aem(spark, path, cores or []).drop("path")
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, inferSchema=False)
        names = cores or [c for c in rows.columns if c not in KEYS]
        return from_trip_list(rows, "origin", "destination", names)
    if path.endswith(".omx"):
        raise ImportError("OMX files need an HDF5 library; convert them to AEM or Parquet")
    rows = spark.read.parquet(path)
    return rows.select(*KEYS, *(cores or cores_of(rows)))


def write_matrix(od: DataFrame, path: str, cores: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet by origin ranges; .csv keeps cells with any core other than 0. Honours the chosen cores in every format."""
    rows = od.select(*KEYS, *(cores or cores_of(od)))
    if path.endswith(".csv"):
        nonzero(rows).write.mode(mode).csv(path, header=True)
    elif path.endswith(".aem"):
        pdf = nan_to_zero(rows).toPandas()
        with open(path, "xb" if mode == "errorifexists" else "wb") as f:
            f.write(encode(pdf, cores_of(rows)))
    else:
        rows.repartitionByRange("origin").write.mode(mode).option("compression", "zstd").parquet(path)


def unique_names(names: list[str], most: int = CORE) -> list[str]:
    """Names cut to a length and numbered where they clash."""
    out: list[str] = []
    for n in names:
        cut, k = n[:most], 1
        while cut in out:
            tail = f"_{k}"
            cut, k = n[: most - len(tail)] + tail, k + 1
        out.append(cut)
    return out


def od_count(od: DataFrame) -> int:
    return od.agg(F.count("*")).first()[0]
