"""Nothing of its own: the dialect has no streaming.

Scan, filter and project are stateless, so a SELECT without LIMIT also runs over a
streaming DataFrame that was given to ``Engine.register``.
"""
