"""Two tiny ONNX models, written as protocol buffers by hand: the onnx package isn't installed."""

import struct

import numpy as np


def _number(n):
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number, value):
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    data = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(data)) + data


def _value(name, kind, *dims):
    shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _node(op, inputs, output, *attributes):
    return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, op) + b"".join(_field(5, a) for a in attributes)


def _mean(inputs, output, axes):
    ints = _field(1, "axes") + b"".join(_field(8, a) for a in axes) + _field(20, 7)
    return _node("ReduceMean", inputs, output, ints, _field(1, "keepdims") + _field(3, 0) + _field(20, 2))


def _model(nodes, inputs, outputs, tensors=()):
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "g") + b"".join(_field(5, t) for t in tensors) + b"".join(_field(11, i) for i in inputs) + b"".join(_field(12, o) for o in outputs)
    return _field(1, 7) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


FLOAT, INT32, INT64 = 1, 6, 7


def text_model(table: np.ndarray, kind=INT64) -> bytes:
    """ids -> the mean of their rows of a table."""
    rows, dim = table.shape
    tensor = _field(1, rows) + _field(1, dim) + _field(2, FLOAT) + _field(8, "table") + _field(9, struct.pack(f"<{rows * dim}f", *table.reshape(-1)))
    return _model([_node("Gather", ["table", "ids"], "rows"), _mean(["rows"], "vector", [1])], [_value("ids", kind, "b", "l")], [_value("vector", FLOAT, "b", dim)], [tensor])


def image_model(channels: int, height: int, width: int) -> bytes:
    """pixels -> the mean of each channel."""
    return _model([_mean(["pixels"], "vector", [2, 3])], [_value("pixels", FLOAT, "b", channels, height, width)], [_value("vector", FLOAT, "b", channels)])
