"""siltstone.functions"""

from .register import register_all  # noqa: F401
