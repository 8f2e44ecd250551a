"""Training-data operators: mixing, secret scans, packing, HTML extraction,
token output, sharding, media matching, quality rules, chat formatting and
n-gram joins. Nothing outside this subpackage imports it."""
