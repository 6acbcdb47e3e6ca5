"""Configuration of runs: files, environment, defaults, and their written form."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, fields
from pathlib import Path

from evoframe.plans.evolve import EvolutionConfig
from evoframe.sources.models import Registry, with_environment

#: What holds where no default file is found (fixed values).
BUILT_IN = {"parallel": {"batch_size": 20, "max_concurrent_requests": 100}}
PREFIX = "EVOFRAME_"


def read_mapping(path: str) -> dict:
    """A JSON or YAML file; YAML needs the yaml package."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML files need the yaml package; use JSON") from error
    return yaml.safe_load(text) or {}


def default_config(path: str) -> dict:
    """The defaults in a file, or the built-in ones where there is none."""
    return read_mapping(path) if os.path.exists(path) else json.loads(json.dumps(BUILT_IN))


def parsed_ratio(value) -> float:
    """A number, or 'a/b'."""
    if isinstance(value, str) and "/" in value:
        a, b = value.split("/")
        return float(a) / float(b)
    return float(value)


def evolution_config(held: Mapping, **changes) -> EvolutionConfig:
    """From a mapping, under 'evolution' or at its root; keys it doesn't know are an error, None changes nothing."""
    held = dict(held.get("evolution", held)) | {k: v for k, v in changes.items() if v is not None}
    known = {f.name for f in fields(EvolutionConfig)}
    if unknown := sorted(set(held) - known):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    for name in ("vanilla_ratio", "elite_ratio"):
        if name in held:
            held[name] = parsed_ratio(held[name])
    if "modes" in held:
        held["modes"] = tuple(dict(held["modes"]).items())
    if "length_bounds" in held:
        held["length_bounds"] = tuple(held["length_bounds"])
    return EvolutionConfig(**held)


def config_from_file(path: str | None, **changes) -> EvolutionConfig:
    return evolution_config(read_mapping(path) if path else {}, **changes)


def config_from_environment(environment: Mapping[str, str] | None = None, **changes) -> EvolutionConfig:
    """Numbers from variables such as EVOFRAME_POPULATION; others keep their defaults."""
    environment = os.environ if environment is None else environment
    plain = {f.name: type(f.default) for f in fields(EvolutionConfig) if isinstance(f.default, int | float)}
    held = {k: kind(environment[PREFIX + k.upper()]) for k, kind in plain.items() if PREFIX + k.upper() in environment}
    return evolution_config(held, **changes)


def write_config(config: EvolutionConfig, path: str) -> None:
    """A file that config_from_file() reads back."""
    held = asdict(config) | {"modes": dict(config.modes), "length_bounds": list(config.length_bounds)}
    if path.endswith(".json"):
        text = json.dumps({"evolution": held}, indent=2)
    else:
        import yaml

        text = yaml.safe_dump({"evolution": held}, sort_keys=False)
    Path(path).write_text(text, encoding="utf-8")


def models_from_file(path: str) -> Registry:
    """A model catalog: 'thinkers' with name, model, base_url and api_key, and an optional 'operator' for all variation."""
    return Registry.from_mapping(read_mapping(path))


def models_from_environment(environment: Mapping[str, str] | None = None) -> Registry:
    """One thinker per name in EVOFRAME_MODELS, at EVOFRAME_BASE_URL with EVOFRAME_API_KEY."""
    environment = os.environ if environment is None else environment
    names = [n.strip() for n in environment.get(PREFIX + "MODELS", "").split(",") if n.strip()]
    base, key = (with_environment(environment.get(PREFIX + k, "")) for k in ("BASE_URL", "API_KEY"))
    return Registry.from_mapping({"thinkers": [{"name": n, "base_url": base, "api_key": key} for n in names], "operator": environment.get(PREFIX + "OPERATOR")})
