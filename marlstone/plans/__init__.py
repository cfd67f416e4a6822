from . import cleaning, desk, expressions, factors, library, news, reports, research, streams, trading  # noqa: F401
