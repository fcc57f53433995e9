"""What can go wrong, each as a class of its own; all are BrindleError."""


class BrindleError(Exception):
    """Base of all errors of this library."""


class IndexOutOfRange(BrindleError, IndexError):
    """An index outside the shape."""


class RangeError(BrindleError, ValueError):
    """A range whose end lies before its start."""


class DomainError(BrindleError, ValueError):
    """An argument outside a function's domain."""


class IncompatibleSize(BrindleError, ValueError):
    """Operands whose sizes don't fit."""


class NeedNonempty(BrindleError, ValueError):
    """An empty operand where one entry at least is needed."""


class ChangeStaticSize(BrindleError, TypeError):
    """A fixed shape can't be changed."""


class ArgumentResultConflict(BrindleError, ValueError):
    """An argument is also the result."""


class IncompatibleShape(BrindleError, TypeError):
    """Operands of kinds that don't combine."""


class MatrixNotSquare(BrindleError, ValueError):
    """A square matrix is needed."""


class MatrixTooSmall(BrindleError, ValueError):
    """The matrix has too few rows or columns."""


class MatrixSingular(BrindleError, ArithmeticError):
    """A pivot is zero or nearly so."""


class MissingDiagonal(BrindleError, ValueError):
    """A stored diagonal entry is needed in every row."""


class AccessDuringInsertion(BrindleError, RuntimeError):
    """A matrix is read while an inserter is open on it."""


class UnexpectedResult(BrindleError, RuntimeError):
    """A result that contradicts the arguments."""


class RuntimeFailure(BrindleError, RuntimeError):
    """Any other failure while running."""


class DivisionByZero(BrindleError, ZeroDivisionError):
    """Division by zero where it is not allowed."""


class LogicError(BrindleError, RuntimeError):
    """A wrong use of the library."""


class IoError(BrindleError, OSError):
    """A file can't be read or written as asked."""


class FileNotFound(IoError, FileNotFoundError):
    """There is no such file."""


class SearchSpaceExhaustion(BrindleError, ArithmeticError):
    """A solver ran out of directions."""


class UnexpectedOrthogonality(BrindleError, ArithmeticError):
    """Two vectors of a solver are orthogonal that must not be."""


class TooLarge(BrindleError, MemoryError):
    """A step that gathers its operand was given one above its stated bound."""
