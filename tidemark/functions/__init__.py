"""Column-level helpers (JVM-side expressions only)."""

from tidemark.functions.keys import hash_key, hash_int, hash_unit  # noqa: F401
from tidemark.functions.vec import (  # noqa: F401
    dot, sq_dist, euclid, relu, sigmoid, vec_add, vec_scale, lerp, argmax, one_hot_array,
)
