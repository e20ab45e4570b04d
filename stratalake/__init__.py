"""Analytics for stores of layered memory images on Spark: content-addressed pages, layered manifests, exploration trees, garbage
collection and integrity checks as DataFrame operators."""
