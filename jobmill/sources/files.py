"""Small files in whatever file system a path names, through Hadoop's classes."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    place, system = _place(spark, folder)
    return [status.getPath().getName() for status in system.listStatus(place)] if system.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _place(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless one of that name exists; false if it does.

    The text is written under a name of its own and takes its final name in one step that fails if the name is taken: a hard
    link on local disks, a rename without overwriting elsewhere (atomic in HDFS).  So a reader sees all of it or nothing, and of
    several writers one wins.
    """
    folder, name = path.rsplit("/", 1)
    draft, system = _place(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if system.getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        gateway = spark.sparkContext._gateway
        rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        qualified = system.makeQualified(draft)
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(qualified, system.makeQualified(final), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        if system.exists(draft):
            system.delete(draft, False)
