"""Single files in any file system that Hadoop knows."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _at(spark, path)
    return fs.exists(jpath)


def folders(spark: SparkSession, root: str) -> list[str]:
    """Sorted names of the folders below root."""
    fs, jpath = _at(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, jpath = _at(spark, path)
    out = fs.create(jpath, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def put_json(spark: SparkSession, path: str, value) -> None:
    put_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def get_json(spark: SparkSession, path: str):
    return json.loads(get_text(spark, path))


def copy(spark: SparkSession, source: str, target: str) -> None:
    (fs, a), (to, b) = _at(spark, source), _at(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, True, spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _at(spark, path)
    fs.delete(jpath, True)
