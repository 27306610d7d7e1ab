"""Sources of matrices and vectors: PETSc binary files, arrays, generators."""

from .arrays import from_csr, from_entries
from .generators import gaussian, tridiagonal
from .petsc import read_matrix, read_vector, register, write_matrix, write_vector

__all__ = ["from_csr", "from_entries", "gaussian", "read_matrix", "read_vector", "register", "tridiagonal", "write_matrix", "write_vector"]
