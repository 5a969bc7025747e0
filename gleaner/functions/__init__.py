"""Part of gleaner; see the package README."""
