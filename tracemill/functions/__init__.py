"""Column functions: identities, paths, time keys, codecs."""
