"""Column functions: everything here takes and returns ``Column`` and stays inside codegen."""
