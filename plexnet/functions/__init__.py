"""Column functions: activations and md5 counter draws."""
