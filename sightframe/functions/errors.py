"""Errors as struct columns, so that a bad row is a row and not an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID_PARAMS, INVALID_REQUEST, UNSUPPORTED_TOOL = "INVALID_PARAMS", "INVALID_REQUEST", "UNSUPPORTED_TOOL"
ERROR = "struct<code:string,message:string>"
#: Numbers of the codes in JSON-RPC.
RPC_CODES = {INVALID_PARAMS: -32602, INVALID_REQUEST: -32600, UNSUPPORTED_TOOL: -32601}


def error(code: str, message: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def first_error(*errors: Column) -> Column:
    """The first error that is there, in the order given."""
    return F.coalesce(*errors)


def rpc_code(code: Column) -> Column:
    out = None
    for name, number in RPC_CODES.items():
        out = F.when(code == name, number) if out is None else out.when(code == name, number)
    return out


def tool_route(tool: Column) -> Column:
    """``core`` for the three tools, null for others."""
    return F.when(tool.isin("read_image", "image_probe", "crop_region"), "core")
