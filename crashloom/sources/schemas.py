"""Schemas of crash reports and of what is derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)
_S, _A = T.StringType(), T.ArrayType(T.StringType())

SEVERITY = T.StructType([T.StructField(n, _S) for n in ("Type", "ShortDescription", "Description", "Explanation")])

REPORT = T.StructType(
    [T.StructField(n, _S) for n in ("Date", "Uname", "OS", "OSRelease", "Architecture", "ExecutablePath")]
    + [T.StructField("ProcEnviron", _A), T.StructField("ProcCmdline", _S), T.StructField("Stdin", _S)]
    + [T.StructField(n, _A) for n in ("ProcStatus", "ProcMaps", "ProcFiles", "NetworkConnections")]
    + [T.StructField("CrashSeverity", SEVERITY), T.StructField("Stacktrace", _A), T.StructField("Registers", T.MapType(_S, U64)), T.StructField("Disassembly", _A)]
    + [T.StructField(n, _S) for n in ("Package", "PackageVersion", "PackageArchitecture", "PackageDescription")]
    + [T.StructField(n, _A) for n in ("AsanReport", "MsanReport", "UbsanReport", "LuaReport", "PythonReport", "GoReport", "JavaReport", "RustReport", "JsReport", "CSharpReport")]
    + [T.StructField("CrashLine", _S), T.StructField("Source", _A)]
)

#: A frame: absent text is '' and an absent number 0, never null.
FRAME = "struct<address:decimal(20,0),function:string,module:string,offset:decimal(20,0),debug:struct<file:string,line:bigint,column:bigint>>"
