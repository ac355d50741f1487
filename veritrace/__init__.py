"""Watch-list screening over Spark DataFrames."""

__all__ = ["Client", "Settings", "Weights"]


def __getattr__(name: str):
    # Loaded when asked for: workers that run one function need no more than its module.
    if name == "Client":
        from .client import Client

        return Client
    if name in ("Settings", "Weights"):
        from . import config

        return getattr(config, name)
    raise AttributeError(name)
