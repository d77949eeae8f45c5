"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``marlstone.llm.entry`` holds the
queries and their SQL for the driver contract.
"""
