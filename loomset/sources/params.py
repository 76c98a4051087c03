"""Parameters of requests from a TOML file that is read again when it changes."""

from __future__ import annotations

import os
import tomllib
from dataclasses import fields, replace

from loomset.operators.recommend import Params


class ParamsFile:
    """get() gives the file's parameters, read anew after each change; without a file the last ones, at first defaults."""

    def __init__(self, path: str):
        self.path, self._seen, self._params = path, None, Params()

    def get(self) -> Params:
        try:
            seen = os.stat(self.path).st_mtime_ns
        except OSError:
            return self._params
        if seen != self._seen:
            with open(self.path, "rb") as f:
                raw = tomllib.load(f)
            flat = {k: v for x in (raw, *(v for v in raw.values() if isinstance(v, dict))) for k, v in x.items() if not isinstance(v, dict)}
            names = {"consistencia": "w_consistency", "pico": "pop_peak", "largura": "pop_width", "candidatos_por_seed": "n_candidates", "resultados": "k"}  # fixed values: the file's keys
            known = {f.name for f in fields(Params)}
            given = {names.get(k, k): v for k, v in flat.items()}
            self._params, self._seen = Params(**{k: v for k, v in given.items() if k in known}), seen
        return self._params

    def with_filters(self, **filters) -> Params:
        """The current parameters with a request's filters."""
        return replace(self.get(), **filters)
