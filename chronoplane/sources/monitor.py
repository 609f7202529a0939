"""Files of the resource monitor: binary samples of CPUs, network interfaces and disks, one file per host and kind.

Every file is decoded by one task from Spark's binary file source into rows (host, kind, part, metric, start_ns,
end_ns, value, max_value). A file that breaks off ends with its last whole message.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import files_in

# File name prefixes, limits of the metrics, and the share of busy time from which a core counts as full.
KINDS = {"proc-stat-": "cpu", "proc-net-dev-": "network", "proc-diskstats-": "disk"}
NETWORK_LIMIT, DISK_LIMIT, FULL_CORE = 1e9, 1e8, 0.95
COUNTERS_PER_CORE, IDLE_COUNTER, SECTOR = 10, 3, 512

SAMPLES = "host string, kind string, part string, metric string, start_ns long, end_ns long, value double, max_value double"


class Reader:
    """Little-endian and LEB128 primitives over a byte string."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise EOFError
        self.at += 1
        return self.data[self.at - 1]

    def long(self) -> int:
        if self.at + 8 > len(self.data):
            raise EOFError
        self.at += 8
        return struct.unpack_from("<q", self.data, self.at - 8)[0]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return out

    def string(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise EOFError
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def messages(r: Reader, one) -> Iterator[tuple[int, list[int]]]:
    """(timestamp, counters) of whole messages until the data end or stop making sense."""
    try:
        while True:
            yield r.long(), one()
    except (EOFError, ValueError):
        return


def decode_cpu(data: bytes) -> Iterator[tuple[str, str, int, int, float, float]]:
    r = Reader(data)
    cores = 0

    def one() -> list[int]:
        nonlocal cores
        n = r.varint()
        if cores and n != cores:
            raise ValueError("the number of cores changed")
        cores = n
        return [r.varint() for _ in range(n * COUNTERS_PER_CORE)]

    last = None
    for time, counters in messages(r, one):
        if last is not None and time > last:
            c = np.array(counters, dtype=np.float64).reshape(cores, COUNTERS_PER_CORE)
            total = c.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                busy = (total - c[:, IDLE_COUNTER]) / total
            yield "", "utilization", last, time, float(busy.sum()), float(cores)
            yield "", "cores-fully-utilized", last, time, float((busy >= FULL_CORE).sum()), float(cores)
            for i, b in enumerate(busy):
                yield str(i), "utilization", last, time, float(b), 1.0
        last = time


def _listed(data: bytes, counters: int) -> Iterator[tuple[int, int, list[str], list[list[int]]]]:
    """Files that begin with a list of names; then (previous time, time, names, counters of each name)."""
    r = Reader(data)
    try:
        last, tag = r.long(), r.byte()
        if tag != 0:
            raise ValueError("the first message must list names")
        names = [r.string() for _ in range(r.varint())]
    except EOFError:
        return

    def one() -> list[int]:
        if r.byte() != 1:
            raise ValueError("a repeated list of names")
        r.varint()
        return [r.varint() for _ in range(counters * len(names))]

    for time, flat in messages(r, one):
        if time > last:  # a period without length has no rates
            yield last, time, names, [flat[i * counters : (i + 1) * counters] for i in range(len(names))]
        last = time


def decode_network(data: bytes) -> Iterator[tuple[str, str, int, int, float, float]]:
    for last, time, names, rows in _listed(data, 4):
        for name, (received, _, sent, _) in zip(names, rows, strict=True):
            yield name, "bytes-received", last, time, received * 1e9 / (time - last), NETWORK_LIMIT
            yield name, "bytes-sent", last, time, sent * 1e9 / (time - last), NETWORK_LIMIT


def decode_disk(data: bytes) -> Iterator[tuple[str, str, int, int, float, float]]:
    for last, time, names, rows in _listed(data, 7):
        d = time - last
        for name, (_, read, read_ms, _, written, write_ms, total_ms) in zip(names, rows, strict=True):
            yield name, "bytes-read", last, time, read * SECTOR * 1e9 / d, DISK_LIMIT
            yield name, "bytes-written", last, time, written * SECTOR * 1e9 / d, DISK_LIMIT
            yield name, "read-time", last, time, read_ms * 1e6 / d, 1.0
            yield name, "write-time", last, time, write_ms * 1e6 / d, 1.0
            yield name, "total-utilization", last, time, min(1.0, total_ms * 1e6 / d), 1.0


DECODERS = {"cpu": decode_cpu, "network": decode_network, "disk": decode_disk}


def decode_files(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in files:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            name = path.rpartition("/")[2]
            kind = next(k for prefix, k in KINDS.items() if name.startswith(prefix))
            host = name.rpartition("-")[2]
            rows = [(host, kind, *row) for row in DECODERS[kind](bytes(content))]
            yield pd.DataFrame(rows, columns=["host", "kind", "part", "metric", "start_ns", "end_ns", "value", "max_value"])


def resource_path(typed: bool = False) -> Column:
    """/cluster/machine[hostname=h]/..., or the type path without instances."""
    tag = lambda key, value: F.lit("") if typed else F.concat(F.lit(f"[{key}="), value, F.lit("]"))
    machine = F.concat(F.lit("/cluster/machine"), tag("hostname", F.col("host")))
    part = (
        F.when((F.col("kind") == "cpu") & (F.col("part") == ""), F.lit("/cpu"))
        .when(F.col("kind") == "cpu", F.concat(F.lit("/cpu/core"), tag("id", F.col("part"))))
        .when(F.col("kind") == "network", F.concat(F.lit("/network"), tag("iface", F.col("part"))))
        .otherwise(F.concat(F.lit("/disk"), tag("device", F.col("part"))))
    )
    return F.concat(machine, part, F.lit(":"), F.col("metric"))


def read_monitor(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """(metric_path, metric_type, machine, start_ns, end_ns, value, max_value), or None without monitor files.

    Where a host's files leave a gap, one period of value 0 fills it; files of a host that overlap are an error. A
    disk's total utilization goes if it never rises above 0.
    """
    paths = [f for d in folders for f in files_in(spark, f"{d}/metrics/resource-monitor", recursive=True) if f.rpartition("/")[2].startswith(tuple(KINDS))]
    if not paths:
        return None
    samples = spark.read.format("binaryFile").load(paths).select("path", "content").repartition(max(1, min(len(paths), 1_000))).mapInPandas(decode_files, SAMPLES)
    keys = ["host", "kind", "part", "metric"]
    order = Window.partitionBy(*keys).orderBy("start_ns")
    overlap = F.when(F.col("next") < F.col("end_ns"), F.raise_error(F.lit("metric files overlap")).cast("double")).otherwise(F.col("value"))
    spaced = samples.withColumn("next", F.lead("start_ns").over(order)).withColumn("value", overlap)
    same = F.struct("start_ns", "end_ns", "value")
    hole = F.struct(F.col("end_ns").alias("start_ns"), F.col("next").alias("end_ns"), F.lit(0.0).alias("value"))
    filled = spaced.withColumn("p", F.explode(F.when(F.col("next") > F.col("end_ns"), F.array(same, hole)).otherwise(F.array(same))))
    filled = filled.select(*keys, "p.*", "max_value")
    idle = F.max("value").over(Window.partitionBy(*keys))
    kept = filled.withColumn("most", idle).filter((F.col("metric") != "total-utilization") | (F.col("most") > 0))
    return kept.select(resource_path().alias("metric_path"), resource_path(typed=True).alias("metric_type"), F.col("host").alias("machine"), "start_ns", "end_ns", "value", "max_value")
