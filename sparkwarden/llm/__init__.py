"""Operators for preparing training data: near copies, search, quality, leaks, mixing, token files, shards, lines, urls, chats."""
