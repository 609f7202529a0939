"""Machine names: ``hosts`` files with one machine a line, its canonical name first, then aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import is_file, whole_texts


def parse_hosts(texts: list[str]) -> dict[str, set[str]]:
    """canonical name -> all names; lines that begin with # are comments; a name belongs to one machine."""
    machines: dict[str, set[str]] = {}
    owner: dict[str, str] = {}
    for line in (x.strip() for t in texts for x in t.splitlines()):
        if not line or line.startswith("#"):
            continue
        names = line.split()
        for name in names:
            if owner.setdefault(name, names[0]) != names[0]:
                raise ValueError(f"machine name {name!r} belongs to {owner[name]!r} and to {names[0]!r}")
        machines.setdefault(names[0], set()).update(names)
    return machines


def read_hosts(spark: SparkSession, folders: list[str]) -> dict[str, str]:
    """Every name -> canonical name."""
    texts = whole_texts(spark, [f"{d}/hosts" for d in folders if is_file(spark, f"{d}/hosts")])
    return {name: canonical for canonical, names in parse_hosts(list(texts.values())).items() for name in names}


def alias_frame(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(aliases.items()), "alias string, canonical string")
