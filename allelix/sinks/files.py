"""Writing under names that are free: an output never takes the place of another, also if several runs write at once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame


def write_free(lines: DataFrame, path: str) -> str:
    """Writes the lines as text and gives the name: path, or path.1, path.2, ... whichever is the first that is free.

    They are written under a name of their own, and the finished folder is renamed; the file system refuses to rename over what
    exists, so of two runs that want a name one gets the next.
    """
    spark = lines.sparkSession
    own = f"{path}.writing-{uuid.uuid4().hex}"
    lines.write.text(own)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(own)
    files = hadoop.FileContext.getFileContext(source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    k, name = 0, path
    while True:
        if not files.util().exists(hadoop.Path(name)):
            try:
                files.rename(source, hadoop.Path(name), how)
                return name
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                    raise
        k += 1
        name = f"{path}.{k}"
