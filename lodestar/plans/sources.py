"""A source tree over the tables: one small product for each supplier, written by templates.

``__K__`` stands for the supplier's key, and every file begins with as many empty lines as the key
leaves by three, so names and lines differ from product to product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.starmap import Star

MARK = "__K__"
#: Files of a task.
FILES = 2000


def spread(rows: DataFrame, each: int, *by: str) -> DataFrame:
    """``rows`` dealt over tasks of about so many: a small table is one task, whatever is made of its rows."""
    tasks = -(-rows.count() // each)
    return rows if tasks < 2 else rows.repartition(tasks, *by)


def files(star: Star, templates: list[tuple[str, str]]) -> DataFrame:
    """(path, text, repository) of all products, each a repository of its own."""
    keys = star.table("supplier").select(F.col("s_suppkey").cast("string").alias("k"), (F.col("s_suppkey") % 3).cast("int").alias("gap"))
    each = [F.struct(F.lit(path).alias("path"), F.lit(text).alias("text")) for path, text in templates]
    rows = spread(keys, max(1, FILES // len(templates)), "k").select("k", "gap", F.explode(F.array(*each)).alias("f"))
    return rows.select(F.replace("f.path", F.lit(MARK), F.col("k")).alias("path"), F.concat(F.repeat(F.lit("\n"), F.col("gap")), F.replace("f.text", F.lit(MARK), F.col("k"))).alias("text"), "k").withColumnRenamed("k", "repository")


def facts_sql(found: list[tuple]) -> str:
    """The DuckDB query for (path, line, kind, name, detail, confidence) in every product; a line of 0 is the first, wherever the text begins."""
    quoted = lambda v: "null::varchar" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(p)}, {n}, {quoted(k)}, {quoted(w)}, {quoted(d)}, {c}::double)" for p, n, k, w, d, c in found)
    put = lambda c: f"replace({c}, '{MARK}', k) as {c}"
    return f"""with keys as (select s_suppkey::varchar as k, s_suppkey % 3 as gap from supplier), t(path, line, kind, name, detail, confidence) as (values {rows})
select {put('path')}, (case when line = 0 then 1 else line + gap end)::integer as line, kind, {put('name')}, {put('detail')}, confidence from keys cross join t"""


#: What a product's numbers begin at, by its key.
STEP = 1000


def products(star: Star, rows: list[tuple], schema: str, numbered: tuple[str, ...] = ()) -> DataFrame:
    """The rows for every supplier: __K__ in texts is its key, ``numbered`` columns count from STEP times the key."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    keys = star.table("supplier").select(F.col("s_suppkey").alias("k"))

    def value(v, name: str, kind: str):
        if isinstance(v, str):
            return F.replace(F.lit(v), F.lit(MARK), F.col("k").cast("string"))
        return (F.lit(v) + STEP * F.col("k") if name in numbered else F.lit(v)).cast(kind)

    each = F.array(*[F.struct(*[value(v, n, t).cast(t).alias(n) for v, (n, t) in zip(r, fields)]) for r in rows])
    return keys.select(F.explode(each).alias("r")).select("r.*")


def products_sql(rows: list[tuple], columns: str, numbered: tuple[str, ...] = ()) -> str:
    """The same for DuckDB: a query in parentheses."""
    names = [c.strip() for c in columns.split(",")]
    quoted = lambda v: "null" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    said = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    text = [any(isinstance(r[i], str) for r in rows) for i in range(len(names))]
    put = ", ".join(f"replace({n}, '{MARK}', s_suppkey::varchar) as {n}" if t else f"({n} + {STEP} * s_suppkey)::bigint as {n}" if n in numbered else n for n, t in zip(names, text))
    return f"(select {put} from supplier cross join (values {said}) t({', '.join(names)}))"


REACT = [
    ("p__K__/src/App__K__.tsx", """"use client";
import { LineChart } from "recharts";
import { Route } from "react-router-dom";
const API = "/api/v__K__";
export const User__K__Context = createContext(null);
export default function App__K__({ title, items }) {
  const [statusFilter, setStatusFilter] = useState("a");
  const [selectedFilters, setSelectedFilters] = useState([]);
  const [filterOpen, setFilterOpen] = useState(false);
  const [activeTab, setActiveTab] = useState("a");
  const user = useAuth__K__();
  const shown = items.filter(x => x.state === statusFilter);
  fetch(`${API}/items`);
  fetch("/api/orders", { method: "post" });
  apiClient.put("https://host/api/items/7");
  fetch("/logo.svg");
  return items.length === 0 ? <Empty__K__>No items yet</Empty__K__> : <div><h1>All items</h1><LineChart /><Users__K__ /></div>;
}
"""),
    ("p__K__/src/Users__K__.tsx", """import { hasRole } from "./roles";
export const Users__K__ = ({ id }) => {
  if (hasRole(ROLES.ADMIN) || hasRole("SHOP.EDIT")) errors.name = "Name is required";
  const handleExportCsv = () => setInterval(poll, 1000);
  return <form><input {...register("email")} /><table><tr><th>Name</th><th>{x}</th><th><b>Due</b> date</th></tr></table></form>;
};
function handleSubmit(e) {
  e.city = "City is required";
}
"""),
    ("p__K__/src/auth__K__.ts", """import { PublicClientApplication } from "@azure/msal-browser";
export function useAuth__K__() { localStorage.setItem("access_token", "x"); return localStorage.getItem("access_token"); }
export const ROLES = { ADMIN: "admin__K__", VIEWER: "viewer" };
function getDefaultRoute(role) {
  switch (role) {
    case ROLES.ADMIN: return "/users/__K__";
    case ROLES.VIEWER:
      return "/home";
  }
}
const id = process.env.AUTH_CLIENT_ID;
"""),
    ("p__K__/src/routes.tsx", """import { Routes, Route } from "react-router-dom";
const a = <Routes><Route path="/users/__K__" element={<ProtectedRoute allowedRoles={[ROLES.ADMIN, ROLES.OWNER]}><Users__K__ /></ProtectedRoute>} />
<Route path="" element={<Home />} /></Routes>;
"""),
    ("p__K__/src/router.ts", """const r = createBrowserRouter([
  { path: "/a__K__", element: <PrivateRoute><Page__K__ /></PrivateRoute> },
  { path: "/b", element: <B /> }
]);
"""),
    ("p__K__/src/Grid__K__.tsx", """const t = useReactTable({ columns: [{ accessorKey: "id" }, { accessorKey: "name" }] });
const f = <input type="file" />;
"""),
    ("p__K__/app/(shop)/items/[id]/page.tsx", "export default function Page__K__() { return <Users__K__ />; }\n"),
]
ANGULAR = [
    ("p__K__/app/list__K__.component.ts", """@Component({ selector: 'app-list', templateUrl: './list__K__.component.html' })
export class List__K__Component {
  baseUrl = 'https://host/api/v__K__';
  statusFilter = '';
  panelFilterOpen = false;
  form = { name: new FormControl('', [Validators.required, Validators.email]), note: new FormControl('') };
  constructor(private http: HttpClient, private svc: List__K__Service, n: number) { this.http.get<string[]>('/api/list'); this.http.post(`${this.baseUrl}/items`, {}); this.http.get(this.baseUrl); }
  rows() { return this.all.filter(x => x.status === this.statusFilter); }
}
"""),
    ("p__K__/app/row.component.ts", "@Component({ selector: 'app-row__K__', template: '' })\nexport class Row__K__Component {}\n"),
    ("p__K__/app/list__K__.component.html", "<div>\n<app-row__K__></app-row__K__></div>\n"),
    ("p__K__/app/list.service.ts", "@Injectable({ providedIn: 'root' })\nexport class List__K__Service {}\nexport class Auth__K__Guard implements CanActivate {}\nexport const load: ResolveFn<X> = () => 1;\n"),
    ("p__K__/app/routes.ts", "const routes: Routes = [{ path: 'a__K__', component: AComponent, children: [{ path: 'b', component: BComponent }] }, { path: 'g', children: [{ path: 'c', component: CComponent }] },\n{ path: 'l', loadChildren: () => import('./l').then(m => m.LazyModule) }, { path: 'old', redirectTo: 'a__K__' }];\n"),
]
DOTNET = [
    ("p__K__/Api/Api__K__.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><PackageReference Include="MediatR" Version="12.__K__" /><PackageReference Include="Dapper"><Version>2.1</Version></PackageReference><PackageReference Include="Own.Lib__K__" /><ProjectReference Include="..\\Core\\Core__K__.csproj" /></ItemGroup></Project>'),
    ("p__K__/Api/appsettings.json", '{ // settings\n "ConnectionStrings": { "Main__K__": "Server=x", } }'),
    ("p__K__/Api/Program.cs", """using MassTransit;
var app = builder.Build();
builder.Services.AddScoped<IOrder__K__Store, Order__K__Repository>();
builder.Services.AddSingleton<IClock>(sp => new Clock__K__());
builder.Services.AddTransient(typeof(IList<>), typeof(Listed__K__<>));
builder.Services.AddCors(o => { o.AddPolicy("Web", p => p.WithOrigins("https://a", "https://b")); });
builder.Services.AddAuthorization(o => o.AddPolicy("Admins__K__", p => p.RequireRole("admin").RequireClaim("org")));
builder.Services.AddMemoryCache();
var shop = app.MapGroup("/shop__K__");
var inner = shop.MapGroup("/in");
app.UseAuthentication();
shop.MapGet("/items/{id:int}", (int id) => id).RequireAuthorization();
inner.MapPost("/items", () => 1);
app.MapDelete("/all", () => 1);
var key = builder.Configuration["Jwt:Key__K__"];
var home = Environment.GetEnvironmentVariable("HOME__K__");
"""),
    ("p__K__/Api/Orders__K__Controller.cs", """using MediatR;
namespace Shop.Api;
[Authorize(Roles = "admin")]
[Route("api/[controller]")]
public class Orders__K__Controller : ControllerBase
{
  public Orders__K__Controller(IMediator mediator, Order__K__Service service) { }
  [HttpGet("{id:int}")]
  public async Task<Order> Get(int id) => await mediator.Send(new GetOrder__K__Query(id));
  [HttpPost]
  [AllowAnonymous]
  public async Task<int> Create(Order__K__Dto dto)
  {
    var command = new MakeOrder__K__Command(dto);
    return await _mediator.Send(command);
  }
}
public record GetOrder__K__Query(int Id) : IRequest<Order__K__>;
public record MakeOrder__K__Command(Order__K__Dto Dto) : IRequest;
public record Order__K__Made(int Id) : INotification;
public class MakeOrder__K__Handler : IRequestHandler<MakeOrder__K__Command, int>
{
  public MakeOrder__K__Handler(Shop__K__DbContext db) { }
  public async Task<int> Handle(MakeOrder__K__Command c)
  {
    _db.Orders.Add(new Order__K__());
    await _db.SaveChangesAsync();
    await publisher.Publish(new Order__K__Made(1));
    return 1;
  }
}
"""),
    ("p__K__/Core/Data__K__.cs", """using Microsoft.EntityFrameworkCore;
using Dapper;
public class Shop__K__DbContext : DbContext
{
  public DbSet<Order__K__> Orders { get; set; }
  public DbSet<Line__K__> Lines { get; set; }
  protected override void OnModelCreating(ModelBuilder b)
  {
    b.Entity<Order__K__>().ToTable("orders__K__").HasKey(o => o.Code);
    b.Entity<Order__K__>().HasMany(o => o.Lines).WithOne(l => l.Order).HasForeignKey(l => l.OrderId);
    b.Entity<Line__K__>().HasOne<Order__K__>().WithOne();
  }
}
public class Order__K__
{
  [Key]
  public string Code { get; set; }
  [Required]
  public string Name { get; set; }
  public List<Line__K__> Lines { get; set; }
}
public class Line__K__
{
  public int Id { get; set; }
  public Order__K__ Order { get; set; }
}
public class Order__K__Repository : IOrder__K__Store
{
  private SqlConnection connection;
  public async Task<List<Order__K__>> Open() => await _db.Orders.AsNoTracking().Where(o => o.Name == "x").OrderBy(o => o.Code).ToListAsync();
  public void Raw() { _db.Orders.FromSqlRaw("EXEC find__K__"); connection.Query<Order__K__>("select 1"); }
  public int Size(List<int> xs) { return xs.Count(); }
}
public interface IOrder__K__Store { }
public class Init__K__ : Migration
{
  protected override void Up(MigrationBuilder m)
  {
    m.CreateTable(name: "orders__K__", columns: t => new { Id = t.Column<int>() });
    m.AddColumn<string>("note", "orders");
  }
}
"""),
    ("p__K__/Core/Messages__K__.cs", """using RabbitMQ.Client;
using FluentValidation;
using System.Threading;
public class Order__K__Service
{
  public void ValidateOrder(Order__K__ o)
  {
    if (o.Status == "Open" || o.Status == "Closed") throw new InvalidOperationException("must be open __K__");
    _audit.LogChange("order changed");
    _emailService.SendReceipt(o);
    _channel.BasicPublish("x", new Order__K__Sent());
    httpClient.GetAsync("https://other/api/__K__");
  }
  public void Other() { throw new InvalidOperationException("not a rule"); }
}
public class Order__K__Sent { }
public class Sent__K__Consumer : IConsumer<Order__K__Sent> { var args = "x-dead-letter-exchange"; }
public class Order__K__Validator : AbstractValidator<Order__K__Sent>
{
  public Order__K__Validator() { RuleFor(x => x.Name).NotEmpty().MaximumLength(50); RuleFor(x => x.Age).GreaterThan(0); }
}
public class Tick__K__ : BackgroundService { Timer t = new Timer(); }
public class Trace__K__Filter : IAsyncActionFilter { }
public class Hooks__K__
{
  [Function("Hook__K__")]
  public void Run([QueueTrigger("q")] string m) { }
}
"""),
]
