"""Schemas that come with the package, as YAML files beside this one."""
