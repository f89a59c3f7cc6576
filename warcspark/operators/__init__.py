"""DataFrame operators on records: parse, validate, repair, build, marshal, revisit, analyse."""
