"""Column functions: hash uniforms and grouped rank statistics."""
