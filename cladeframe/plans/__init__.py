"""Jobs made of several operators: enumeration and search."""
