"""Java functions for loops that neither an expression nor numpy does in time: compiled by the Janino that Spark brings, sent to the executors as a jar."""

from __future__ import annotations

import hashlib
import os
import tempfile
import warnings
import zipfile

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string


def java_function(spark: SparkSession, name: str, source: str, returns: str) -> str | None:
    """The name under which the class ``name`` of a Java ``source`` (a UDF of Spark's Java interface) can be called; None where it can't be made.

    The name has the source's digest, so a session registers each version once.
    """
    own = f"{name}_{hashlib.md5(source.encode()).hexdigest()[:12]}"
    if getattr(spark, "_jvm", None) is None:
        return None
    try:
        if spark.catalog.functionExists(own):
            return own
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source.replace(name, own))
        path = os.path.join(tempfile.mkdtemp(prefix="affinade-"), f"{own}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for entry in compiler.getBytecodes().entrySet():
                jar.writestr(f"{entry.getKey().replace('.', '/')}.class", bytes(entry.getValue()))
        spark.sql(f"ADD JAR '{path}'")
        loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()  # which has the jars added
        made = loader.loadClass(own).newInstance()
        kind = spark._jsparkSession.parseDataType(_parse_datatype_string(returns).json())
        once = spark._jvm.org.apache.spark.sql.functions.udf(made, kind).asNondeterministic()  # or filters that Spark infers call it again
        spark._jsparkSession.udf().register(own, once)
    except (Py4JError, PySparkException, TypeError) as error:  # no Janino, or no jar may be added
        warnings.warn(f"{name} isn't compiled, numpy takes its place: {error}", stacklevel=2)
        return None
    return own
