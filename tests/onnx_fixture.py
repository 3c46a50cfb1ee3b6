"""A tiny ONNX sequence classifier and tokenizer, written without the onnx package.

The model reads ``input_ids`` and ``attention_mask`` (int64, [batch, seq]) and returns
``logits`` = [n_tokens, sum_of_ids] @ W  (float32, [batch, 3]), so a test can recompute the
expected logits from the tokenizer's output. The protobuf wire format is encoded by hand with
the field numbers of the public ONNX schema.
"""

from __future__ import annotations


import numpy as np

WEIGHTS = np.array([[0.5, -0.25, 0.1], [0.01, 0.02, -0.03]], dtype=np.float32)
FLOAT, INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        b = n & 0x7F
        n >>= 7
        out.append(b | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _key(num: int, wire: int) -> bytes:
    return _varint((num << 3) | wire)


def _int(num: int, v: int) -> bytes:
    return _key(num, 0) + _varint(v)


def _bytes(num: int, v: bytes | str) -> bytes:
    b = v.encode() if isinstance(v, str) else v
    return _key(num, 2) + _varint(len(b)) + b


def _attr_int(name: str, v: int) -> bytes:          # AttributeProto, type INT = 2
    return _bytes(1, name) + _int(3, v) + _int(20, 2)


def _attr_ints(name: str, vs: list[int]) -> bytes:  # AttributeProto, type INTS = 7
    return _bytes(1, name) + b"".join(_int(8, v) for v in vs) + _int(20, 7)


def _node(op: str, inputs: list[str], outputs: list[str], attrs: list[bytes] = ()) -> bytes:
    body = b"".join(_bytes(1, i) for i in inputs) + b"".join(_bytes(2, o) for o in outputs)
    body += _bytes(3, f"{op}_{outputs[0]}") + _bytes(4, op) + b"".join(_bytes(5, a) for a in attrs)
    return _bytes(1, body)


def _value_info(num: int, name: str, elem: int, dims: list) -> bytes:
    shape = b"".join(_bytes(1, _bytes(2, d) if isinstance(d, str) else _int(1, d)) for d in dims)
    tensor_type = _int(1, elem) + _bytes(2, shape)
    return _bytes(num, _bytes(1, name) + _bytes(2, _bytes(1, tensor_type)))


def _initializer(name: str, arr: np.ndarray) -> bytes:
    body = b"".join(_int(1, d) for d in arr.shape) + _int(2, FLOAT) + _bytes(8, name)
    body += _bytes(9, arr.astype("<f4").tobytes())
    return _bytes(5, body)


def model_bytes() -> bytes:
    nodes = [
        _node("Cast", ["attention_mask"], ["mask_f"], [_attr_int("to", FLOAT)]),
        _node("Cast", ["input_ids"], ["ids_f"], [_attr_int("to", FLOAT)]),
        _node("Mul", ["ids_f", "mask_f"], ["ids_masked"]),
        _node("ReduceSum", ["mask_f"], ["n_tok"], [_attr_ints("axes", [1]), _attr_int("keepdims", 1)]),
        _node("ReduceSum", ["ids_masked"], ["id_sum"], [_attr_ints("axes", [1]), _attr_int("keepdims", 1)]),
        _node("Concat", ["n_tok", "id_sum"], ["feat"], [_attr_int("axis", 1)]),
        _node("MatMul", ["feat", "W"], ["logits"]),
    ]
    graph = b"".join(nodes) + _bytes(2, "tiny") + _initializer("W", WEIGHTS)
    graph += _value_info(11, "input_ids", INT64, ["batch", "seq"])
    graph += _value_info(11, "attention_mask", INT64, ["batch", "seq"])
    graph += _value_info(12, "logits", FLOAT, ["batch", 3])
    opset = _bytes(1, "") + _int(2, 11)
    return _int(1, 7) + _bytes(2, "test") + _bytes(7, graph) + _bytes(8, opset)


def write_fixture(directory: str) -> tuple[str, str]:
    """Write ``model.onnx`` and ``tokenizer.json``; returns their paths."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = "the a an and of is to in it on bus train station late clean good bad".split()
    vocab = {"[PAD]": 0, "[UNK]": 1, **{w: i + 2 for i, w in enumerate(words)}}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok_path, model_path = f"{directory}/tokenizer.json", f"{directory}/model.onnx"
    tok.save(tok_path)
    with open(model_path, "wb") as f:
        f.write(model_bytes())
    return model_path, tok_path


def expected_logits(tok_path: str, texts: list[str], max_length: int) -> np.ndarray:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tok_path)
    out = []
    for t in texts:
        ids = tok.encode(t).ids[:max_length]
        feat = np.array([[len(ids), sum(ids)]], dtype=np.float32)
        out.append((feat @ WEIGHTS)[0])
    return np.array(out, dtype=np.float64)


